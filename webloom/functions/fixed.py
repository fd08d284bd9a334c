"""Names, hosts, patterns and tables that results depend on."""

from __future__ import annotations

SOCIAL_HOSTS = (
    "twitter.com x.com facebook.com fb.com instagram.com linkedin.com youtube.com github.com reddit.com tiktok.com"
    " pinterest.com mastodon.social threads.net bsky.app discord.com discord.gg"
).split()
DOWNLOAD_ENDINGS = (
    ".pdf .doc .docx .xls .xlsx .csv .zip .tar .gz .tar.gz .rar .7z .pptx .ppt .txt .rtf .epub .mobi"
).split()
UNSAFE_SCHEMES = ("javascript", "data", "vbscript")
PAGINATION_TEXT = r"(?i)^(next|prev|previous|newer|older|»|«|›|‹|>>|<<|[0-9]+)$"
NAVIGATION_NAMES = r"(?i)nav|menu|sidebar|footer|breadcrumb|pagination|pager"

TRACKING_SOURCE = r"(?i)pixel|track|beacon|spacer|blank|(?<![a-z0-9-])1x1(?![a-z0-9-])|transparent\.gif"
ICON_SOURCE = r"(?i)icon|logo|avatar|sprite|favicon"
IMAGE_ENDINGS = "jpg jpeg png gif webp svg avif".split()

BOT_CHALLENGES = (
    "request access",
    "just a moment",
    "checking your browser",
    "cf-browser-verification",
    'src="https://geo.captcha-delivery.com',
    'class="ctp-c"',
    "ak_bmsc",
    "px-captcha",
    "perimeterx",
)
BOT_FRIENDLY_HOSTS = (
    "sec.gov govinfo.gov federalregister.gov ecfr.gov congress.gov uscourts.gov courtlistener.com irs.gov fcc.gov"
    " ftc.gov doj.gov treasury.gov data.gov europa.eu"
).split()

SECURITY_HEADERS = (
    "strict-transport-security content-security-policy x-frame-options x-content-type-options referrer-policy"
    " permissions-policy x-xss-protection cross-origin-opener-policy cross-origin-resource-policy"
).split()
#: In the order in which they are looked for.
SERVER_NAMES = {
    "nginx": "nginx",
    "apache": "Apache",
    "microsoft-iis": "Microsoft-IIS",
    "iis": "Microsoft-IIS",
    "litespeed": "LiteSpeed",
    "caddy": "Caddy",
    "tomcat": "Apache Tomcat",
    "jetty": "Jetty",
    "gunicorn": "Gunicorn",
    "uvicorn": "Uvicorn",
    "openresty": "OpenResty",
    "envoy": "Envoy",
}
CDN_NAMES = {
    "cloudflare": "Cloudflare",
    "cloudfront": "CloudFront",
    "akamai": "Akamai",
    "fastly": "Fastly",
    "vercel": "Vercel",
    "netlify": "Netlify",
    "stackpath": "StackPath",
    "sucuri": "Sucuri",
    "incapsula": "Incapsula",
    "imperva": "Imperva",
}
CACHEABLE_STATUS = (200, 203, 204, 206, 300, 301, 404, 405, 410, 414, 501)
AUTH_HEADERS = "authorization proxy-authorization cookie x-api-key x-auth-token x-csrf-token".split()
REDACTED_HEADERS = (
    "authorization proxy-authorization cookie set-cookie x-api-key x-auth-token x-csrf-token".split()
)
REDACTED_NAMES = r"secret|token|api[_-]?key|password|auth"
DKIM_SELECTORS = (
    "default google selector1 selector2 k1 s1 s2 mail dkim smtp mandrill mailjet".split()
)

ORG_TYPES = (
    "Organization Corporation LocalBusiness LegalService ProfessionalService FinancialService"
    " GovernmentOrganization NGO EducationalOrganization MedicalOrganization SportsOrganization PerformingGroup"
    " Airline LawFirm AccountingService Attorney"
).split()
ORG_SOCIAL = {
    "linkedin.com": "linkedin",
    "twitter.com": "twitter",
    "x.com": "twitter",
    "facebook.com": "facebook",
    "instagram.com": "instagram",
    "github.com": "github",
    "youtube.com": "youtube",
}
ENTITY_FORMS = (
    r"(?i)\b(LLC|L\.L\.C\.|LLP|L\.L\.P\.|Inc\.|Incorporated|Ltd\.|Limited|Corp\.|Corporation|PLC|P\.L\.C\.|GmbH|AG"
    r"|S\.A\.|S\.r\.l\.|PLLC|P\.A\.|Professional Association)(?![A-Za-z])"
)
TITLE_SEPARATORS = (" | ", " - ", " — ", " :: ", " » ")

TWO_PART_SUFFIXES = """
co.uk org.uk ac.uk gov.uk me.uk net.uk sch.uk com.au net.au org.au edu.au gov.au asn.au id.au co.jp ac.jp ne.jp or.jp go.jp
com.br net.br org.br gov.br edu.br co.in net.in org.in gen.in firm.in ind.in gov.in ac.in edu.in res.in
co.nz net.nz org.nz govt.nz ac.nz co.za org.za net.za gov.za ac.za com.cn net.cn org.cn gov.cn edu.cn
com.hk org.hk net.hk edu.hk gov.hk co.kr or.kr ne.kr re.kr pe.kr go.kr ac.kr com.sg net.sg org.sg edu.sg gov.sg
com.tw net.tw org.tw edu.tw gov.tw com.tr net.tr org.tr gen.tr gov.tr edu.tr com.mx net.mx org.mx gob.mx edu.mx
com.ar net.ar org.ar gov.ar edu.ar com.co net.co org.co gov.co edu.co co.il org.il net.il ac.il gov.il
co.th in.th ac.th go.th or.th net.th com.my net.my org.my gov.my edu.my co.id or.id ac.id go.id web.id
com.ng org.ng net.ng gov.ng edu.ng co.ke or.ke ne.ke go.ke ac.ke com.eg org.eg net.eg gov.eg edu.eg
com.pk net.pk org.pk gov.pk edu.pk com.bd net.bd org.bd gov.bd edu.bd com.vn net.vn org.vn gov.vn edu.vn
com.ph net.ph org.ph gov.ph edu.ph
""".split()

WHOIS_DEFAULT = "whois.iana.org"
WHOIS_SERVERS = {
    "com": "whois.verisign-grs.com",
    "net": "whois.verisign-grs.com",
    "org": "whois.pir.org",
    "info": "whois.afilias.net",
    "biz": "whois.biz",
    "us": "whois.nic.us",
    "co": "whois.nic.co",
    "io": "whois.nic.io",
    "ai": "whois.nic.ai",
    "dev": "whois.nic.google",
    "app": "whois.nic.google",
    "me": "whois.nic.me",
    "tv": "whois.nic.tv",
    "cc": "ccwhois.verisign-grs.com",
    "uk": "whois.nic.uk",
    "co.uk": "whois.nic.uk",
    "org.uk": "whois.nic.uk",
    "de": "whois.denic.de",
    "fr": "whois.nic.fr",
    "nl": "whois.sidn.nl",
    "eu": "whois.eu",
    "be": "whois.dns.be",
    "ch": "whois.nic.ch",
    "at": "whois.nic.at",
    "it": "whois.nic.it",
    "es": "whois.nic.es",
    "pt": "whois.dns.pt",
    "se": "whois.iis.se",
    "no": "whois.norid.no",
    "dk": "whois.dk-hostmaster.dk",
    "fi": "whois.fi",
    "pl": "whois.dns.pl",
    "cz": "whois.nic.cz",
    "ru": "whois.tcinet.ru",
    "au": "whois.auda.org.au",
    "com.au": "whois.auda.org.au",
    "nz": "whois.srs.net.nz",
    "ca": "whois.cira.ca",
    "jp": "whois.jprs.jp",
    "kr": "whois.kr",
    "cn": "whois.cnnic.cn",
    "in": "whois.registry.in",
    "br": "whois.registro.br",
    "mx": "whois.mx",
    "za": "whois.registry.net.za",
    "xyz": "whois.nic.xyz",
    "online": "whois.nic.online",
    "site": "whois.nic.site",
    "tech": "whois.nic.tech",
    "law": "whois.nic.law",
    "legal": "whois.nic.legal",
}
PORT_SERVICES = {
    20: "ftp-data",
    21: "ftp",
    22: "ssh",
    23: "telnet",
    25: "smtp",
    53: "dns",
    67: "dhcp",
    68: "dhcp",
    69: "tftp",
    80: "http",
    110: "pop3",
    111: "rpcbind",
    119: "nntp",
    123: "ntp",
    135: "msrpc",
    139: "netbios-ssn",
    143: "imap",
    161: "snmp",
    162: "snmp-trap",
    179: "bgp",
    389: "ldap",
    443: "https",
    445: "microsoft-ds",
    465: "smtps",
    514: "syslog",
    515: "lpd",
    587: "submission",
    636: "ldaps",
    873: "rsync",
    993: "imaps",
    995: "pop3s",
    1080: "socks",
    1433: "mssql",
    1521: "oracle",
    2049: "nfs",
    2375: "docker",
    3306: "mysql",
    3389: "rdp",
    5432: "postgresql",
    5672: "amqp",
    5900: "vnc",
    5984: "couchdb",
    6379: "redis",
    8080: "http-proxy",
    8443: "https-alt",
    9092: "kafka",
    9200: "elasticsearch",
    11211: "memcached",
    27017: "mongodb",
    27018: "mongodb",
    50000: "db2",
}

#: Class and id names that speak for and against content.
POSITIVE_NAMES = r"article|body|content|entry|main|post|text|blog|story|hentry|page"
NEGATIVE_NAMES = (
    r"comment|sidebar|footer|footnote|\bnav\b|(?:^|[-_ ])ad(?:[-_ ]|$)|sponsor|social|share|widget|popup|banner|cookie|modal"
    r"|\bmenu\b|breadcrumb|pager|pagination|promo|related|shoutbox|combx|masthead|media|\bmeta\b|outbrain|taboola|disqus"
)
STRIPPED_TAGS = "script style link noscript iframe embed object applet svg".split()

#: The learned content model: for each feature its weight, mean and scale; and the bias.
CONTENT_BIAS = -0.486090
CONTENT_MODEL = {
    "log_text_length": (-0.162834, 3.797387, 1.911634),
    "log_text_density": (0.012019, 2.979457, 1.436591),
    "log_descendant_count": (0.002070, 1.100273, 1.134662),
    "link_density": (0.072390, 0.132191, 0.247083),
    "non_link_text_ratio": (-0.072390, 0.867809, 0.247083),
    "class_weight": (0.338445, -0.082437, 0.427982),
    "tag_weight": (-0.111737, 0.222939, 0.643281),
    "depth": (0.654090, 0.539785, 0.287046),
    "position_centrality": (0.840166, 0.416594, 0.297674),
    "sibling_log_text_density": (0.124704, 2.672409, 1.735365),
    "same_tag_sibling_ratio": (0.070097, 0.311167, 0.398042),
    "same_class_sibling_ratio": (0.394895, 0.066985, 0.221979),
    "sentence_score": (0.438460, 0.111708, 0.217161),
    "comma_density": (-0.239501, 0.004013, 0.010769),
    "has_block_children": (-0.391829, 0.340502, 0.473878),
    "paragraph_score_density": (0.333655, 0.038935, 0.143793),
    "anchor_count_ratio": (-0.062324, 0.239405, 0.348313),
    "interactive_ratio": (-0.261470, 0.030271, 0.147821),
    "heading_ratio": (0.126789, 0.036028, 0.121167),
    "paragraph_ratio": (0.243455, 0.054054, 0.169979),
    "list_item_ratio": (-0.073112, 0.058268, 0.158559),
    "repeated_child_tag_ratio": (-0.066230, 0.561862, 0.454788),
    "repeated_child_signature_ratio": (-0.064363, 0.539580, 0.449100),
    "positive_class": (-0.081514, 0.060932, 0.239205),
    "negative_class": (-0.468961, 0.143369, 0.350449),
    "ancestor_positive_bias": (0.333316, 0.473118, 0.499277),
    "ancestor_negative_bias": (-0.332848, 0.146953, 0.354059),
    "is_article_like": (0.537384, 0.089606, 0.285616),
    "is_paragraph_like": (0.901563, 0.405018, 0.490896),
    "is_list_like": (0.250385, 0.078853, 0.269509),
    "is_boilerplate_tag": (-0.624699, 0.125448, 0.331226),
    "is_form_tag": (-0.312407, 0.014337, 0.118875),
    "under_content_landmark": (0.147389, 0.731183, 0.443345),
    "under_boilerplate_landmark": (-1.903748, 0.283154, 0.450531),
    "has_repeated_children": (-0.221445, 0.580645, 0.493454),
}

#: Consent managers by the id, class or data-tid that shows them.
CONSENT_MANAGERS = {
    "OneTrust": ("id", "onetrust-banner-sdk"),
    "CookieBot": ("id", "CybotCookiebotDialog"),
    "TrustArc": ("id", "truste-consent-track"),
    "Quantcast Choice": ("class", "qc-cmp2-summary-buttons"),
    "Complianz": ("class", "cmplz-cookiebanner"),
    "Osano": ("class", "osano-cm-dialog"),
    "Didomi": ("id", "didomi-notice"),
    "Termly": ("data-tid", "banner-accept"),
}

#: Hand-set weights of the content features, and their bias.
HAND_BIAS = -2.2
HAND_WEIGHTS = {
    "log_text_length": 0.55,
    "log_text_density": 0.7,
    "log_descendant_count": 0.15,
    "link_density": -2.4,
    "non_link_text_ratio": 0.55,
    "class_weight": 0.45,
    "tag_weight": 0.55,
    "depth": 0.15,
    "position_centrality": 0.2,
    "sibling_log_text_density": 0.25,
    "same_tag_sibling_ratio": 0.35,
    "same_class_sibling_ratio": 0.2,
    "sentence_score": 0.55,
    "comma_density": 12.0,
    "has_block_children": 0.35,
    "paragraph_score_density": 18.0,
    "anchor_count_ratio": -0.6,
    "interactive_ratio": -2.0,
    "heading_ratio": 0.3,
    "paragraph_ratio": 0.25,
    "list_item_ratio": 0.3,
    "repeated_child_tag_ratio": 0.35,
    "repeated_child_signature_ratio": 0.45,
    "positive_class": 0.45,
    "negative_class": -1.0,
    "ancestor_positive_bias": 0.2,
    "ancestor_negative_bias": -0.6,
    "is_article_like": 0.85,
    "is_paragraph_like": 0.45,
    "is_list_like": 0.25,
    "is_boilerplate_tag": -1.1,
    "is_form_tag": -0.8,
    "under_content_landmark": 0.4,
    "under_boilerplate_landmark": -0.8,
    "has_repeated_children": 0.45,
}

#: The groups of content features that an ablation leaves out.
FEATURE_GROUPS = {
    "text_content": (
        "log_text_length log_text_density log_descendant_count sentence_score comma_density paragraph_score_density paragraph_ratio"
    ),
    "link_interactive": "link_density non_link_text_ratio anchor_count_ratio interactive_ratio heading_ratio",
    "structure_context": (
        "depth position_centrality sibling_log_text_density same_tag_sibling_ratio same_class_sibling_ratio has_block_children"
        " under_content_landmark under_boilerplate_landmark"
    ),
    "template_repetition": (
        "list_item_ratio repeated_child_tag_ratio repeated_child_signature_ratio has_repeated_children is_list_like"
    ),
    "semantic_priors": (
        "class_weight tag_weight positive_class negative_class ancestor_positive_bias ancestor_negative_bias is_article_like"
        " is_paragraph_like is_boilerplate_tag is_form_tag"
    ),
}
