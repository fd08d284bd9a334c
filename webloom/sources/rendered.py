"""Recorded inputs rendered from the star-schema tables.

The pages table holds neither images, structured data, feeds nor probe results, so
these documents are rendered from table columns by DataFrame expressions; what an
operator finds in them can be checked against the columns themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.plans.common import table


def text(*parts: Column | str) -> Column:
    """Strings and columns joined; a null counts as empty."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def og_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as company pages; every third lacks og:title, every fifth structured data."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    key, name = F.col("c_custkey"), F.col("c_name")
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    ld = text(
        '<script type="application/ld+json">{"@type":"Organization","name":"', name, '","legalName":"', name,
        ' LLC","telephone":"+', key, '","address":{"addressCountry":"', F.col("n_name"), '","postalCode":"', key,
        '"},"sameAs":["https://www.linkedin.com/c/', key, '","https://github.com/c', key,
        '"],"datePublished":"2024-01-02","author":{"name":"Ed ', key, '"}}</script>',
    )
    html = text(
        '<!DOCTYPE html><html lang="en"><head><title>', name, " | ", F.col("c_mktsegment"), "</title>",
        F.when(key % 3 != 0, text('<meta property="og:title" content="', name, ' &amp; Co">')),
        '<meta property="og:site_name" content="', F.col("c_mktsegment"), '"><meta name="Description" content="About ',
        name, '"><meta property="og:image" content="https://img.example.com/', key, '.png">',
        '<link rel="canonical" href="https://c', key, '.example.com/">', F.when(key % 5 != 0, ld),
        "</head><body><article><h1>", name, "</h1><p>Balance ", F.col("c_acctbal"), "</p></article><footer>",
        name, " is organized under the laws of the State of Nevada. Company Number: ", key, "-77</footer></body></html>",
    )
    return rows.select(key.alias("page_id"), text("https://c", key, ".example.com/home?x=1").alias("url"), html.alias("html"))


def image_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as product pages with one picture of each kind."""
    key, name = F.col("p_partkey"), F.col("p_name")
    html = text(
        '<html><body><figure><img src="/img/', key, '.jpg" alt="', name, '" width="', F.col("p_size") + 50, 'px" height="60"',
        ' srcset="/img/', key, "-1.jpg 1x, /img/", key, '-2.jpg 2x"><figcaption>', F.col("p_brand"), "</figcaption></figure>",
        '<img data-src="/lazy/', key, '.webp" src="x.gif" alt="', F.col("p_type"), '">',
        '<img src="/t/pixel.gif?p=', key, '" width="1" height="1"><img src="/deco/', key, '.svg" alt="">',
        '<p>', name, '<img src="/logo/', key, '.png" class="brand"></p>',
        '<img src="/img/', key, '.jpg" alt="again"></body></html>',
    )
    return table(spark, sf_dir, "part").select(key.alias("page_id"), F.lit("https://shop.example.com/p/1").alias("url"), html.alias("html"))


def table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each customer as one table."""
    row = text(
        "<tr><td>", F.col("o_orderkey"), "</td><td>", F.col("o_orderstatus"), "</td><td>",
        F.col("o_totalprice").cast("decimal(18,2)"), "</td></tr>",
    )
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("row")))), lambda r: r["row"]), "")
    head = "<table><thead><tr><th>key<th>status<th>price</thead><tbody>"
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(
        F.lit("https://orders.example.com/").alias("url"), text("<html><body>", head, rows, "</tbody></table></body></html>").alias("html")
    )


def feed_docs(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """The orders (of the table, if none are given) of each customer as a feed: RSS for even keys, Atom for odd ones."""
    key, when = F.col("o_orderkey"), F.col("o_orderdate")
    rss = text(
        "<item><title>Order ", key, " &amp; more</title><link>https://s.example.com/o/", key, "</link><description>",
        F.col("o_orderpriority"), "</description><dc:creator>", F.col("o_orderstatus"), "</dc:creator><guid>g", key,
        "</guid><category>c", key % 3, "</category><pubDate>", F.date_format(when, "E, dd MMM yyyy HH:mm:ss"),
        " +0200</pubDate></item>",
    )
    atom = text(
        "<entry><title>Order ", key, ' &amp; more</title><link rel="self" href="https://x.example.com/"/><link href="https://s.example.com/o/',
        key, '"/><summary>', F.col("o_orderpriority"), "</summary><author><name>", F.col("o_orderstatus"), "</name></author><id>g",
        key, '</id><category term="c', key % 3, '"/><updated>', F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss"), "+02:00</updated></entry>",
    )
    even = F.col("o_custkey") % 2 == 0
    item = F.when(even, rss).otherwise(atom)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("item")))), lambda r: r["item"]), "")
    orders = table(spark, sf_dir, "orders") if orders is None else orders
    feeds = orders.groupBy("o_custkey").agg(body.alias("items"))
    start = text('<?xml version="1.0"?><rss version="2.0"><channel><title>Feed ', F.col("o_custkey"), "</title>", F.col("items"), "</channel></rss>")
    # Atom feeds are cut off in their end tags: complete entries must still be found.
    other = text('<feed xmlns="http://www.w3.org/2005/Atom"><title>Feed ', F.col("o_custkey"), "</title>", F.col("items"), "</fee")
    return feeds.select(F.col("o_custkey").alias("feed_id"), F.when(even, start).otherwise(other).alias("body"))


def sitemap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as sitemaps, one a brand, with an index of them all, and an index of that one."""
    key, brand = F.col("p_partkey"), F.col("p_brand")
    entry = text(
        "<url><loc>https://shop.example.com/p/", key, "</loc><lastmod>20", F.lpad((key % 24).cast("string"), 2, "0"),
        "-0", key % 9 + 1, "</lastmod><priority>", F.when(key % 10 == 0, "7.5").otherwise(text("0.", key % 10)), "</priority></url>",
    )
    entries = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, entry.alias("e")))), lambda r: r["e"]), "")
    leaves = table(spark, sf_dir, "part").groupBy(brand.alias("brand")).agg(
        text('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', entries, "</urlset>").alias("body")
    )
    leaves = leaves.select(text("https://shop.example.com/", F.col("brand"), ".xml").alias("url"), "body")
    locs = F.array_join(F.transform(F.array_sort(F.collect_list("url")), lambda u: text("<sitemap><loc>", u, "</loc></sitemap>")), "")
    index = leaves.agg(text("<sitemapindex>", locs, "<sitemap><loc>https://shop.example.com/root.xml</loc></sitemap></sitemapindex>").alias("body"))
    middle = index.select(F.lit("https://shop.example.com/all.xml").alias("url"), "body")
    root = spark.createDataFrame(
        [("https://shop.example.com/root.xml", "<sitemapindex><sitemap><loc>https://shop.example.com/all.xml</loc></sitemap></sitemapindex>")],
        "url string, body string",
    )
    return leaves.unionByName(middle).unionByName(root)


def robots_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A robots.txt for the host of each nation."""
    key = F.col("n_nationkey")
    body = text(
        "# rules\nUser-agent: *\nDisallow: /private/", key, "\nAllow: /\nSitemap: https://n", key, ".example.com/sitemap.xml\n\n",
        "User-agent: BadBot\nDisallow: /\n",
    )
    return table(spark, sf_dir, "nation").select(text("n", key, ".example.com").alias("host"), body.alias("body"))


def whois_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registration records of suppliers."""
    key = F.col("s_suppkey")
    body = text(
        "% comment line\n\nDomain Name: S", key, ".EXAMPLE.COM\nRegistrar: ", F.col("s_name"), "\nRegistrar: second\n",
        "Creation Date: 2001-02-0", key % 9 + 1, "T03:04:05Z\nRegistry Expiry Date: 0", key % 9 + 1, "-Aug-2030\nUpdated Date: soon\n",
        "Name Server: NS1.S", key, ".NET.\nName Server: ns1.s", key, ".net\nName Server: ns2.s", key, ".net\n",
        "Domain Status: ok\nDomain Status: ok\nDNSSEC: unsigned\nRegistrant Country: N", F.col("s_nationkey"), "\n",
    )
    return table(spark, sf_dir, "supplier").select(key.alias("s_suppkey"), text("s", key, ".example.com").alias("domain"), body.alias("body"))


def http_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response headers, rendered from customers."""
    key = F.col("c_custkey")
    servers = ["nginx/1.24.0", "Apache/2.4.52 (Ubuntu)", "WeirdServer/9.9", "CustomServer", "cloudflare", "AkamaiGHost", ""]
    server = F.element_at(F.array(*[F.lit(s) for s in servers]), (key % 7 + 1).cast("int"))
    headers = F.map_filter(
        F.create_map(
            F.lit("server"), server,
            F.lit("x-frame-options"), F.when(key % 2 == 0, "DENY"),
            F.lit("content-security-policy"), F.when(key % 3 == 0, "default-src 'self'"),
            F.lit("referrer-policy"), F.when(key % 4 == 0, "unsafe-url").when(key % 4 == 1, "no-referrer"),
            F.lit("x-xss-protection"), F.when(key % 5 == 0, "0").when(key % 5 == 1, "1; mode=block"),
            F.lit("x-served-by"), F.when(key % 11 == 0, "cache-lhr1").when(key % 11 == 1, "edge-1"),
            F.lit("set-cookie"), text("id=", key),
            F.lit("x-my-token"), F.when(key % 13 == 0, F.col("c_name")),
            F.lit("cache-control"), F.when(key % 4 == 0, "no-store").when(key % 4 == 1, text("public, max-age=", key % 1000)).when(key % 4 == 2, "No-Cache"),
        ),
        lambda _, value: value.isNotNull(),
    )
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 301, 404, 429, 500, 503, 403, 204)]), (key % 8 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(key.alias("id"), text("https://c", key, ".example.com/").alias("url"), status.alias("status"), headers.alias("headers"))


def banners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service banners, rendered from suppliers."""
    key = F.col("s_suppkey")
    kinds = [
        text("SSH-2.0-OpenSSH_8.", key % 10, "p1 Ubuntu\r\n"),
        text("220 mail", key, ".example.com ESMTP Postfix\r\n"),
        text("220 (vsFTPd 3.0.", key % 10, ")\r\n"),
        text("+OK Dovecot ready\r\n"),
        text("* OK [CAPABILITY IMAP4rev1 SASL-IR] Dovecot ready."),
        text("HTTP/1.1 200 OK\r\nServer: nginx/1.", key, ".0\r\n\r\n"),
        text("-NOAUTH Authentication required."),
        text(""),
        text("garbage ", key),
    ]
    banner = F.element_at(F.array(*kinds), (key % 9 + 1).cast("int"))
    port = F.when(key % 9 == 7, 22).when(key % 9 == 8, F.when(key % 2 == 0, 6379).otherwise(4)).otherwise(1)
    return table(spark, sf_dir, "supplier").select(key.alias("s_suppkey"), banner.alias("banner"), port.alias("port"))


def dns_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name servers, mail exchangers, addresses and policies of customers' domains."""
    key = F.col("c_custkey")
    domain = text("c", key, ".example.com")
    spf = (
        F.when(key % 6 == 0, "v=spf1 include:a.example.com -all")
        .when(key % 6 == 1, "v=spf1 mx ~all")
        .when(key % 6 == 2, "v=spf1 ?all")
        .when(key % 6 == 3, "v=spf1 +all")
        .when(key % 6 == 4, "v=spf1 " + " ".join(f"include:i{i}.example.com" for i in range(11)) + " -all")
    )
    dmarc = (
        F.when(key % 4 == 0, "v=DMARC1; p=quarantine; sp=reject; rua=mailto:d@example.com; pct=100")
        .when(key % 4 == 1, "v=DMARC1; p=none")
        .when(key % 4 == 2, text("v=DMARC1; p=reject; pct=", key % 100))
    )
    records = F.array(
        *[
            F.struct(F.lit(kind).alias("record_type"), name.alias("name"), value.alias("value"))
            for kind, name, value in (
                ("NS", domain, text("ns1.", domain)),
                ("NS", domain, text("ns2.", domain)),
                ("MX", domain, F.when(key % 3 != 0, text("10 mx.", domain))),
                ("A", domain, text("192.0.2.", key % 250)),
                ("DS", domain, F.when(key % 5 == 0, F.lit("12345 8 2 ab"))),
                ("TXT", domain, spf),
                ("TXT", text("_dmarc.", domain), F.when(dmarc.isNotNull(), text('"', dmarc, '"'))),
                ("TXT", text("k1._domainkey.", domain), F.when(key % 2 == 0, F.lit("v=DKIM1; k=rsa; p=abc"))),
            )
        ]
    )
    rows = table(spark, sf_dir, "customer").select(domain.alias("domain"), F.explode(records).alias("r"))
    return rows.select("domain", "r.*").filter("value IS NOT NULL")


def tls_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certificates, rendered from orders."""
    until = F.date_format("o_orderdate", "MMM dd HH:mm:ss yyyy")
    return table(spark, sf_dir, "orders").select("o_orderkey", text(until, " GMT").alias("not_after"), text("CN=h", F.col("o_orderkey"), ".example.com,O=", F.col("o_orderpriority")).alias("subject"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and responses of browsing sessions, rendered from events."""
    key = F.col("event_id")
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("document", "xhr", "image", "script")]), (key % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        key.alias("id"),
        F.col("user_id").alias("session_id"),
        text("https://api.example.com/", F.col("event_type")).alias("url"),
        F.when(key % 3 == 0, "response").otherwise("request").alias("kind"),
        kinds.alias("resource_type"),
        F.when(key % 5 == 0, "text/html").otherwise("application/json; charset=utf-8").alias("content_type"),
        (key * 977 % 2_000_000).alias("content_length"),
        F.when(key % 10 == 0, 302).otherwise(200).alias("status"),
        "ts",
    )


def link_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as pages with a link of each type and position."""
    key = F.col("s_suppkey")
    html = text(
        '<html><head><link rel="next" href="/list?page=', key + 1, '"></head><body><div id="onetrust-banner-sdk" class="x">We use cookies</div>',
        '<header><a href="/home">Home</a></header><nav><a href="/l/', key, '">2</a><a href="javascript:void(0)">js</a></nav>',
        '<div class="left sidebar"><a href="https://www.GitHub.com/s', key, '">code</a></div>',
        '<main><p><a href="/files/', key, '.tar.gz?x=1">Get</a> <a href="mailto:a', key, '@example.com">Mail</a> <a href="#top">Top</a>',
        ' <a rel="Prev nofollow" href="/p/', key, '">back</a> <a href="https://other.example.org/', key, '" title="t"><img alt="Pic" src="i.png"></a>',
        ' <a href="/home">again</a> <a>none</a></p></main><footer><a href="/imprint">Imprint</a></footer></body></html>',
    )
    return table(spark, sf_dir, "supplier").select(key.alias("page_id"), text("https://www.s", key, ".example.com/list?page=", key).alias("url"), html.alias("html"))


def structured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages of four shapes: nested lists; a table with spans; quotes and figures; definitions, code and odd inline elements."""
    key, name, brand, kind, size = F.col("p_partkey"), F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size")
    lists = text(
        "<h1>", name, "</h1><ul><li>", brand, "<ol start=", size, "><li>", kind, "<li><p>one</p><p>two</p></ol><li><b> ", size, " </b></ul>"
    )
    table_ = text(
        "<p>before</p><table><caption>", name, "</caption><thead><tr><th>brand<th>kind|size</thead><tr><td>", brand, "<td>", kind, "<p>", size,
        "</p><tr><td colspan=2><i>", key, "</i></table>",
    )
    quotes = text(
        "<div class='x'><blockquote><p>", name, "</p><blockquote>", brand, "<br>", size, "</blockquote></blockquote></div><figure><img data-src='/i/", key,
        ".png' src='/x.gif' alt='", kind, "'><figcaption>", kind, "</figcaption></figure><hr>",
    )
    odd = text(
        "<dl><dt>", name, "<dt>", brand, "<dd>", kind, "</dl><pre><code class='language-sql'>SELECT ", key, "\nFROM t</code></pre><a href='/n/", key, "'><h2>", kind,
        "</h2></a><p><b><b>", brand, "</b></b> H<sub>2</sub>O<a href='javascript:x()'>bad</a> <s></s><em> e </em>.<span class='sr-only'>hidden</span></p>",
    )
    html = F.when(key % 4 == 0, lists).when(key % 4 == 1, table_).when(key % 4 == 2, quotes).otherwise(odd)
    return table(spark, sf_dir, "part").select(key.alias("page_id"), text("https://e.example.com/d/", key).alias("url"), html.alias("html"))
