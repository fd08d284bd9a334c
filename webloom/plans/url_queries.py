"""Queries over URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import fixed, urls
from webloom.plans.common import host, part, table



def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id",
        urls.scheme(F.col("url")).alias("scheme"),
        urls.netloc(F.col("url")).alias("netloc"),
        urls.path(F.col("url")).alias("path"),
        urls.query(F.col("url")).alias("query"),
        urls.fragment(F.col("url")).alias("fragment"),
    )


REFS = ["/top", "leaf", "../up/leaf", "./here", "?q=1", "#frag", "//cdn.example.net/x", "https://other.example.com/z", ""]


def url_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = F.explode(F.array(*[F.lit(r) for r in REFS])).alias("ref")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", refs)
    return pages.select("page_id", "ref", urls.join(F.col("url"), F.col("ref")).alias("joined"))


def url_crawl_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.crawl_key(F.col("url")).alias("crawl_key"))


def same_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    base = F.concat(F.lit("https://WWW."), urls.host(F.col("url")), F.lit("/start"))
    other = F.when(F.col("page_id") % 2 == 0, base).otherwise("http://elsewhere.example.com/")
    return pages.select("page_id", urls.same_domain(F.col("url"), other).alias("is_same"))


def _domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains under many suffixes, rendered from suppliers."""
    suffixes = ["com", "org", "co.uk", "com.au", "de", "example", "fr", "net.nz"]
    suffix = F.element_at(F.array(*[F.lit(s) for s in suffixes]), (F.col("s_suppkey") % 8 + 1).cast("int"))
    name = F.concat(F.lit("shop"), F.col("s_suppkey").cast("string"))
    deep = F.when(F.col("s_suppkey") % 3 == 0, "a.b.").when(F.col("s_suppkey") % 3 == 1, "www.").otherwise("")
    dot = F.when(F.col("s_suppkey") % 5 == 0, ".").otherwise("")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(deep, name, F.lit("."), suffix, dot).alias("domain"))


DOMAINS_SQL = """
WITH d AS (
    SELECT s_suppkey, ['com', 'org', 'co.uk', 'com.au', 'de', 'example', 'fr', 'net.nz'][s_suppkey % 8 + 1] AS suffix,
        CASE s_suppkey % 3 WHEN 0 THEN 'a.b.' WHEN 1 THEN 'www.' ELSE '' END AS deep,
        CASE WHEN s_suppkey % 5 = 0 THEN '.' ELSE '' END AS dot
    FROM supplier
)
"""


def apex_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _domains(spark, sf_dir).select("s_suppkey", urls.apex_domain(F.col("domain")).alias("apex"))


def whois_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _domains(spark, sf_dir).select("s_suppkey", urls.whois_server(F.col("domain")).alias("server"))


def ua_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the hosts moved under a suffix that wants bot agents."""
    moved = F.when(
        F.col("page_id") % 4 == 0, F.concat(F.lit("https://"), urls.host(F.col("url")), F.lit(".sec.gov:8443/x"))
    ).when(F.col("page_id") % 4 == 1, F.lit("https://not-sec.gov/x")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", urls.wants_bot_agent(moved).alias("bot_agent"))


def rate_limit_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "pages").select(urls.rate_limit_key(F.col("url")).alias("bucket"), urls.robots_url(F.col("url")).alias("robots"))
    return keyed.groupBy("bucket", "robots").agg(F.count("*").alias("n"))


QUERIES = {
    "url_parts": url_parts,
    "url_join": url_join,
    "url_crawl_key": url_crawl_key,
    "same_domain": same_domain,
    "apex_domain": apex_domain,
    "whois_server": whois_server,
    "ua_policy": ua_policy,
    "rate_limit_bucket": rate_limit_bucket,
}

_ORIGIN = f"({part('url', 2)} || '://' || {part('url', 4)})"
_DIR = f"regexp_replace({part('url', 5)}, '[^/]*$', '')"
_UP = f"regexp_replace({_DIR}, '[^/]*/$', '')"
SQL = {
    "url_parts": f"SELECT page_id, {part('url', 2)} AS scheme, {part('url', 4)} AS netloc, {part('url', 5)} AS path,"
    f" {part('url', 7)} AS query, {part('url', 9)} AS fragment FROM pages",
    "url_join": f"""
SELECT page_id, ref, CASE ref
    WHEN '/top' THEN {_ORIGIN} || '/top'
    WHEN 'leaf' THEN {_ORIGIN} || {_DIR} || 'leaf'
    WHEN '../up/leaf' THEN {_ORIGIN} || {_UP} || 'up/leaf'
    WHEN './here' THEN {_ORIGIN} || {_DIR} || 'here'
    WHEN '?q=1' THEN {_ORIGIN} || {part('url', 5)} || '?q=1'
    WHEN '#frag' THEN regexp_replace(url, '#.*$', '') || '#frag'
    WHEN '//cdn.example.net/x' THEN {part('url', 2)} || '://cdn.example.net/x'
    WHEN '' THEN url ELSE ref END AS joined
FROM pages, (SELECT unnest({REFS!r}) AS ref)""",
    "url_crawl_key": f"""
SELECT page_id, {_ORIGIN} || CASE WHEN regexp_replace({part('url', 5)}, '/+$', '') = '' THEN '/'
    ELSE regexp_replace({part('url', 5)}, '/+$', '') END AS crawl_key FROM pages""",
    "same_domain": "SELECT page_id, page_id % 2 = 0 AS is_same FROM pages",
    "apex_domain": DOMAINS_SQL + "SELECT s_suppkey, 'shop' || s_suppkey || '.' || suffix AS apex FROM d",
    "whois_server": DOMAINS_SQL
    + """SELECT s_suppkey, CASE suffix WHEN 'com' THEN 'whois.verisign-grs.com' WHEN 'org' THEN 'whois.pir.org'
    WHEN 'co.uk' THEN 'whois.nic.uk' WHEN 'com.au' THEN 'whois.auda.org.au' WHEN 'de' THEN 'whois.denic.de'
    WHEN 'fr' THEN 'whois.nic.fr' WHEN 'net.nz' THEN 'whois.srs.net.nz' ELSE 'whois.iana.org' END AS server FROM d""",
    "ua_policy": f"SELECT page_id, page_id % 4 = 0 OR (page_id % 4 > 1 AND {host('url')} IN "
    f"({', '.join(map(repr, fixed.BOT_FRIENDLY_HOSTS))})) AS bot_agent FROM pages",
    "rate_limit_bucket": f"SELECT {part('url', 4)} AS bucket, {_ORIGIN} || '/robots.txt' AS robots, count(*) AS n"
    " FROM pages GROUP BY ALL",
}
