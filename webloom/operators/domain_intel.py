"""Domain intelligence: headers, mail policy, registration records, banners, certificates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import fixed


def _named(value: Column, names: dict[str, str]) -> Column:
    """The name of the first key that a lower-case value contains."""
    out = F.lit(None).cast("string")
    for key, name in reversed(names.items()):
        out = F.when(value.contains(key), name).otherwise(out)
    return out


def server_software(server: Column) -> Column:
    """Software named in a Server header, else its text before a slash; null if empty."""
    other = F.trim(F.substring_index(server, "/", 1))
    return F.when(F.coalesce(server, F.lit("")) == "", None).otherwise(F.coalesce(_named(F.lower(server), fixed.SERVER_NAMES), other))


def cdn(headers: Column) -> Column:
    """The network in front of a host, from its Server header, else from tell-tale headers."""
    has = lambda name: F.map_contains_key(headers, name)
    served = F.coalesce(F.lower(F.try_element_at(headers, F.lit("x-served-by"))), F.lit(""))
    server = F.coalesce(F.lower(F.try_element_at(headers, F.lit("server"))), F.lit(""))
    return F.coalesce(
        _named(server, fixed.CDN_NAMES),
        F.when(has("cf-ray"), "Cloudflare")
        .when(has("x-amz-cf-id") | has("x-amz-cf-pop"), "CloudFront")
        .when(served.contains("cache"), "Fastly")
        .when(has("x-vercel-id"), "Vercel")
        .when(has("x-nf-request-id"), "Netlify"),
    )


def header_status(headers: Column, name: str) -> Column:
    """present, weak or missing for one security header."""
    value = F.coalesce(F.try_element_at(headers, F.lit(name)), F.lit(""))
    weak = {"x-xss-protection": "0", "referrer-policy": "unsafe-url"}.get(name)
    return F.when(value == "", "missing").when(F.trim(value) == weak if weak else F.lit(False), "weak").otherwise("present")


def security_score(headers: Column) -> Column:
    """Share of the security headers that are present and not weak, in whole percent."""
    points = sum((header_status(headers, h) == "present").cast("int") for h in fixed.SECURITY_HEADERS)
    return F.floor(points * 100 / len(fixed.SECURITY_HEADERS)).cast("int")


def spf(record: Column) -> dict[str, Column]:
    """policy, lookups, n_issues and status of an SPF record; status missing if there is none."""
    end = F.rtrim(record)
    policy = (
        F.when(end.endswith("-all"), "-all (hard fail)")
        .when(end.endswith("~all"), "~all (soft fail)")
        .when(end.endswith("?all"), "?all (neutral)")
        .when(record.contains("+all"), "+all (pass all)")
    )
    lookups = F.regexp_count(record, F.lit(r"\b(include:|a:|mx:|ptr:|redirect=)"))
    open_ = policy.startswith("?") | policy.startswith("+")
    issues = F.coalesce(open_, ~F.lower(record).contains("all")).cast("int") + (lookups > 10).cast("int")
    weak = record.contains("+all") | record.contains("?all")
    return {
        "policy": policy,
        "lookups": lookups,
        "n_issues": F.coalesce(issues, F.lit(1)),
        "status": F.when(record.isNull(), "missing").when(weak, "weak").otherwise("configured"),
    }


def dmarc(record: Column) -> dict[str, Column]:
    """policy, subdomain_policy, report, pct, n_issues and status of a DMARC record."""
    tag = lambda p: F.nullif(F.regexp_extract(record, p, 1), F.lit(""))
    policy, report = F.lower(tag(r"\bp=(\w+)")), tag(r"\brua=([^;\s]+)")
    pct = tag(r"\bpct=(\d+)").try_cast("int")
    issues = (
        (policy.isNull() | (policy == "none")).cast("int") + report.isNull().cast("int") + F.coalesce(pct < 100, F.lit(False)).cast("int")
    )
    return {
        "policy": policy,
        "subdomain_policy": F.lower(tag(r"\bsp=(\w+)")),
        "report": report,
        "pct": pct,
        "n_issues": F.when(record.isNull(), 1).otherwise(issues),
        "status": F.when(record.isNull(), "missing").when(policy == "none", "weak").otherwise("configured"),
    }


def mail_security(records: DataFrame) -> DataFrame:
    """spf, dkim and dmarc status and the posture of each domain of (domain, record_type, name, value)."""
    txt = F.col("record_type") == "TXT"
    value = F.regexp_replace("value", '^"|"$', "")
    selectors = F.regexp_extract("name", r"^([^.]+)\._domainkey\.", 1).isin(*fixed.DKIM_SELECTORS)
    said = records.select(
        "domain",
        F.when(txt & (F.col("name") == F.col("domain")) & value.startswith("v=spf1"), value).alias("spf"),
        F.when(txt & F.col("name").startswith("_dmarc.") & value.startswith("v=DMARC1"), value).alias("dmarc"),
        F.coalesce(txt & selectors & (value.startswith("v=DKIM1") | value.contains("p=")), F.lit(False)).alias("dkim"),
    )
    # The least of texts is found by sorting: behind the shuffle, where a task has its share of domains, and not in the tasks that read.
    merged = said.repartition("domain").groupBy("domain").agg(F.min("spf").alias("spf"), F.min("dmarc").alias("dmarc"), F.bool_or("dkim").alias("dkim"))
    told = merged.select(
        "domain",
        spf(F.col("spf"))["status"].alias("spf"),
        F.when(F.col("dkim"), "configured").otherwise("missing").alias("dkim"),
        dmarc(F.col("dmarc"))["status"].alias("dmarc"),
    )
    count = lambda status: sum((F.col(c) == status).cast("int") for c in ("spf", "dkim", "dmarc"))
    some = count("configured") + count("weak")
    posture = F.when(count("configured") == 3, "strong").when(some >= 2, "moderate").when(some >= 1, "weak").otherwise("missing")
    return told.withColumn("posture", posture)


def dns_profile(records: DataFrame) -> DataFrame:
    """Name servers, mail exchangers, addresses and DNSSEC of each domain."""
    kind = F.col("record_type")
    host = F.regexp_replace(F.regexp_replace("value", r"^\d+ ", ""), r"\.$", "")
    pick = lambda k: F.array_join(F.array_sort(F.collect_set(F.when(kind == k, host))), ",")
    return records.groupBy("domain").agg(
        pick("NS").alias("nameservers"),
        pick("MX").alias("mx_hosts"),
        pick("A").alias("addresses"),
        F.bool_or(kind.isin("DS", "DNSKEY")).alias("dnssec"),
    )


#: Fixed labels of registration records, by field, in the order in which they are tried.
WHOIS_FIELDS = {
    "registrar": (r"registrar:", r"registrar name:", r"sponsoring registrar:", r"registrar organization:"),
    "whois_server": (r"registrar whois server:", r"whois server:"),
    "creation_date": (
        r"creat(?:ion|ed)\s*(?:date|on)?:",
        r"registration\s*(?:date|time):",
        r"registered\s*(?:date|on)?:",
        r"domain registration date:",
    ),
    "expiration_date": (
        r"expir(?:y|ation|es)\s*(?:date|on)?:",
        r"registry expiry date:",
        r"registrar registration expiration date:",
        r"paid-till:",
        r"validity:",
        r"renewal date:",
    ),
    "updated_date": (
        r"updated?\s*(?:date|on)?:",
        r"last[\s-]*(?:modified|updated|changed)\s*(?:date|on)?:",
        r"last update of whois database:",
    ),
    "registrant_name": (r"registrant\s*(?:name|contact name):",),
    "registrant_org": (r"registrant\s*(?:organization|org|organisation):",),
    "registrant_country": (r"registrant\s*(?:country|country/economy):",),
    "dnssec": (r"dnssec:",),
}
NAME_SERVER = r"(?i)^(?:name\s*server:|nserver:|nameservers?:|dns:)\s*(.+)"
STATUS = r"(?i)^(?:(?:domain )?status:|state:)\s*(.+)"


def whois_date(text: Column) -> Column:
    """A date in one of the registries' formats as an ISO time with its fraction and offset, if it has them; null if it is none.

    ``Z``, UTC and GMT stand for no offset, but for a Z behind a time that a space parts from its date.
    """
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"\.+$", ""), r"(?i)^before\s+", "")
    shape = r"^(\d{4}-\d\d-\d\d)(?:([T ])(\d\d:\d\d:\d\d)(\.\d{1,6})?( ?(?:Z|UTC|GMT|[+-]\d\d:?\d\d|\([+-]\d{4}\)))?)?$"
    part = lambda n: F.regexp_extract(plain, shape, n)
    zone = F.regexp_replace(part(5), r"[ ()]", "")
    offset = F.when(zone.rlike("^[+-]"), F.regexp_replace(zone, r"^([+-]\d\d):?(\d\d)$", "$1:$2")).when((zone == "Z") & (part(2) == " ") & ~part(5).startswith(" "), "+00:00").otherwise("")
    fraction = F.when(part(4).rlike("[1-9]"), F.rpad(part(4), 7, "0")).otherwise("")
    iso = F.concat_ws(" ", F.nullif(part(1), F.lit("")), F.nullif(part(3), F.lit(""))).try_cast("timestamp_ntz")
    shapes = {
        r"^\d\d-[A-Za-z]{3}-\d{4}$": "dd-MMM-yyyy",
        r"^\d{4}/\d\d/\d\d$": "yyyy/MM/dd",
        r"^\d\d/\d\d/\d{4}$": "dd/MM/yyyy",
        r"^\d{4}\.\d\d\.\d\d$": "yyyy.MM.dd",
        r"^\d\d\.\d\d\.\d{4}$": "dd.MM.yyyy",
        r"^\d{8}$": "yyyyMMdd",
        r"^[A-Z][a-z]{2,} \d{1,2}, \d{4}$": "MMMM d, yyyy",
        r"^\d{1,2} [A-Z][a-z]{2,} \d{4}$": "d MMMM yyyy",
    }
    clock = F.regexp_extract(plain, r"^(\d\d-[A-Za-z]{3}-\d{4} \d\d:\d\d:\d\d)( [A-Z]+)?$", 1)
    long_ = F.regexp_replace(plain, r"^[A-Z][a-z]{2} ([A-Z][a-z]{2}) +(\d{1,2}) (\d\d:\d\d:\d\d) (?:UTC|GMT) (\d{4})$", "$4 $1 $2 $3")
    dated = [F.when(plain.rlike(r), F.try_to_timestamp(plain, F.lit(f))).cast("timestamp_ntz") for r, f in shapes.items()]
    timed = F.when(clock != "", F.try_to_timestamp(clock, F.lit("dd-MMM-yyyy HH:mm:ss"))).cast("timestamp_ntz")
    worded = F.when(long_ != plain, F.try_to_timestamp(long_, F.lit("yyyy MMM d HH:mm:ss"))).cast("timestamp_ntz")
    written = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    return F.coalesce(F.concat(written(iso), fraction, offset), written(F.coalesce(*dated, timed, worded)))


def parse_whois(docs: DataFrame) -> DataFrame:
    """The fields of registration records (domain, body): the first line of each field, sets of servers and states."""
    lines = F.filter(F.transform(F.split("body", "\r\n|[\r\n]"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike("^[%#]"))
    rows = docs.select("domain", lines.alias("lines"))

    def first(labels: tuple[str, ...]) -> Column:
        pattern = rf"(?i)^(?:{'|'.join(labels)})\s*(.+)"
        hits = F.filter("lines", lambda x: x.rlike(pattern))
        return F.trim(F.regexp_extract(F.try_element_at(hits, F.lit(1)), pattern, 1))

    def each(pattern: str, clean) -> Column:
        hits = F.transform(F.filter("lines", lambda x: x.rlike(pattern)), lambda x: clean(F.trim(F.regexp_extract(x, pattern, 1))))
        return F.array_distinct(F.filter(hits, lambda x: x != ""))

    dated = ("creation_date", "expiration_date", "updated_date")
    return rows.select(
        "domain",
        *[(whois_date(first(v)) if k in dated else first(v)).alias(k) for k, v in WHOIS_FIELDS.items()],
        each(NAME_SERVER, lambda x: F.lower(F.regexp_replace(x, r"\.+$", ""))).alias("name_servers"),
        each(STATUS, lambda x: x).alias("status"),
    )


def whois_referral(body: Column) -> Column:
    """The registrar's WHOIS server that a record refers to; null if there is none or it is a web address."""
    server = F.regexp_replace(F.regexp_extract(body, r"(?i)registrar whois server:\s*(\S+)", 1), r"\.+$", "")
    return F.when((server != "") & ~server.contains("://"), server)


#: Fixed patterns of service banners, in the order in which they are tried: service, confidence, pattern.
BANNERS = (
    ("ssh", 0.95, r"^SSH-(?<protocol>\d+\.\d+)-(?<product>[^\s_]+)(?:[_\s](?<version>\S+))?"),
    ("imap", 0.9, r"^\*\s+OK\s+\[CAPABILITY[^\]]+\]\s+(?<product>\S+)(?:\s+(?<version>[\d.]+))?"),
    ("pop3", 0.85, r"^\+OK\s+(?<product>\S+?)(?:\s+(?<version>[\d.]+))?(?:\s|$)"),
    ("ftp", 0.9, r"^220[\s\-].*?\((?<product>[\w\s\-]+?)(?:\s+(?<version>[\d.]+))?\)"),
    ("smtp", 0.9, r"(?i)^220[\s\-](?<host>\S+)\s+(?:ESMTP\s+)?(?<product>\S+?)(?:\s+(?<version>[\d.]+))?(?:\s|$)"),
    ("http", 0.9, r"(?im)^Server:\s*(?<product>[\w\-./]+?)(?:/(?<version>[\w.\-]+))?(?:\s|$)"),
)


def port_hint(port: Column) -> Column:
    """The service that a port is known for."""
    known = F.create_map(*[F.lit(x) for pair in fixed.PORT_SERVICES.items() for x in pair])
    return F.try_element_at(known, port.cast("int"))


def fingerprint(banner: Column, port: Column) -> dict[str, Column]:
    """service, product, version and confidence of a banner; the port gives a weak hint."""
    banner = F.coalesce(banner, F.lit(""))
    service, product, version, confidence = [], [], [], []
    for name, sure, pattern in BANNERS:
        groups = [g for g in ("protocol", "host", "product", "version") if f"(?<{g}>" in pattern]
        hit = banner.rlike(pattern)
        get = lambda g: F.nullif(F.trim(F.regexp_extract(banner, pattern, groups.index(g) + 1)), F.lit(""))  # noqa: B023, E731
        service.append(F.when(hit, name))
        confidence.append(F.when(hit, sure))
        own = get("product")
        product.append((hit, F.when(F.upper(own) != "ESMTP", own) if name == "smtp" else own))
        version.append((hit, get("version")))
    redis = banner.rlike("^-NOAUTH") | banner.contains("Redis server")
    service += [F.when(redis, "redis"), port_hint(port), F.lit("unknown")]
    confidence += [F.when(redis, 0.8), F.when(port_hint(port).isNotNull(), 0.3), F.lit(0.0)]
    product.append((redis, F.lit("Redis")))
    version.append((redis, F.nullif(F.regexp_extract(banner, r"(?i)redis_version:([\d.]+)", 1), F.lit(""))))

    def chosen(cases: list[tuple[Column, Column]]) -> Column:
        out = F.lit(None).cast("string")
        for hit, value in reversed(cases):
            out = F.when(hit, value).otherwise(out)
        return out

    return {
        "service": F.coalesce(*service),
        "product": chosen(product),
        "version": chosen(version),
        "confidence": F.coalesce(*confidence),
    }


def tls_expiry(not_after: Column, today: Column) -> Column:
    """Whole days from ``today`` to a certificate's end."""
    end = F.try_to_timestamp(F.regexp_replace(not_after, " [A-Z]+$", ""), F.lit("MMM d HH:mm:ss yyyy"))
    end = F.coalesce(end, F.try_to_timestamp(F.regexp_replace(not_after, " [A-Z]+$", ""), F.lit("MMM dd HH:mm:ss yyyy")))
    return F.floor((F.unix_timestamp(end) - F.unix_timestamp(today)) / 86400).cast("long")


def subject_field(subject: Column, name: str) -> Column:
    """One field of a distinguished name."""
    return F.try_element_at(F.str_to_map(subject, F.lit(","), F.lit("=")), F.lit(name))


def ntp_header(packet: Column) -> dict[str, Column]:
    """The header fields of an NTP answer."""
    byte = lambda i: F.conv(F.hex(F.substring(packet, i, 1)), 16, 10).cast("int")
    signed = lambda v: F.when(v > 127, v - 256).otherwise(v)
    dotted = F.concat_ws(".", *[byte(i).cast("string") for i in range(13, 17)])
    ascii_ = F.regexp_replace(F.decode(F.substring(packet, 13, 4), "US-ASCII"), "\\x00", "")
    return {
        "leap": F.shiftright(byte(1), 6),
        "version": F.shiftright(byte(1), 3).bitwiseAND(7),
        "mode": byte(1).bitwiseAND(7),
        "stratum": byte(2),
        "poll": signed(byte(3)),
        "precision": signed(byte(4)),
        "reference": F.when(byte(2) <= 1, ascii_).otherwise(dotted),
    }
