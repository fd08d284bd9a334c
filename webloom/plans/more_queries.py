"""Queries of sitemap discovery, crawls with a bound, allowed hosts, referrals, handles and whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.operators import discovery, domain_intel, fetch_policy
from webloom.plans import content_queries, policy_queries
from webloom.plans.common import part, table
from webloom.sources import blocks, feeds, rendered
from webloom.sources.rendered import text


def sitemap_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemaps of each nation's host: some have a robots.txt, some only a file in a well-known place, some none."""
    key = F.col("n_nationkey")
    nations = table(spark, sf_dir, "nation")
    domains = nations.select(F.when(key % 2 == 0, text("https://n", key, ".example.com/x")).otherwise(text("n", key, ".example.com")).alias("domain"))
    robots = rendered.robots_docs(spark, sf_dir).filter("cast(regexp_extract(host, '([0-9]+)', 1) AS int) % 4 <> 0")
    body = F.when(key == 12, " ").otherwise("<urlset></urlset>")
    files = nations.filter(key % 3 == 0).select(text("https://n", key, ".example.com/sitemap.xml").alias("url"), body.alias("body"))
    index = nations.filter(key % 8 != 0).select(text("https://n", key, ".example.com/sitemap_index.xml").alias("url"), F.lit("<sitemapindex/>").alias("body"))
    return feeds.discover_sitemaps(domains, robots, files.unionByName(index)).select("domain", "url", "source")


def url_policy_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses counted up from customer keys, most of them closed but for a network, a host and a suffix."""
    k = F.col("c_custkey")
    host = F.when(k % 4 == 0, text("10.1.", k % 250, ".", k % 200)).when(k % 4 == 1, text("h", k % 9, ".internal")).when(
        k % 4 == 2, text("s", k % 9, ".lab.internal")).otherwise("Metadata.Google.Internal")
    allowed = fetch_policy.url_allowed(text("https://u@", host, ":8080/x"), ["10.1.77.0/17", "h5.internal", ".lab.internal", ""])
    return table(spark, sf_dir, "customer").select(k.alias("id"), allowed.alias("allowed"))


def whois_referral(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    server = F.when(key % 3 == 0, text("http://whois", key, ".example.com")).otherwise(text("whois", key, ".example.com."))
    body = text("Domain Name: S", key, "\n   Registrar WHOIS Server: ", server, "\nRegistrar: x\n")
    rows = table(spark, sf_dir, "supplier").select(key.alias("id"), F.when(key % 5 == 0, "Domain Name: x\n").otherwise(body).alias("body"))
    return rows.select("id", F.coalesce(domain_intel.whois_referral(F.col("body")), F.lit("none")).alias("server"))


def discovery_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.discovery_counts(policy_queries.discover_all_urls(spark, sf_dir))


def crawl_first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl that stops at 25 URLs."""
    start = spark.createDataFrame([("https://www.site.example.com/c/1",)], "url string")
    return discovery.crawl(policy_queries.tree_pages(spark, sf_dir), start, max_depth=9, max_pages=25).select("url", "depth", "status")


def url_pattern_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns with repeated groups and a very long one, as include and exclude."""
    long = "|".join(f"/{i}-none$" for i in range(80))
    kept = discovery.matches_patterns(F.col("url"), [r"^/([a-z]+/)+", r"(foo|b+)*x9$"], [r"(?:[aeiou]{2})+[^/]*\.html$", long])
    return table(spark, sf_dir, "pages").filter(kept).select("page_id", "url")


def handle_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    url = F.when(key % 3 == 0, text("store://items/", key, "/body")).when(key % 3 == 1, text("store://text/ ", key)).otherwise(text("https://example.com/", key))
    return table(spark, sf_dir, "part").select(key.alias("id"), F.coalesce(urls.handle_id(url, ["store://items/", "store://text/"]), F.lit("none")).alias("handle"))


def page_markdown_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole markdown of each page without its footer."""
    return blocks.documents(blocks.blocks(table(spark, sf_dir, "pages"), skip=("footer",))).select("page_id", "markdown")


QUERIES = {
    f.__name__: f
    for f in (
        sitemap_discovery, url_policy_allowlist, whois_referral, discovery_counts, crawl_first_pages, url_pattern_linear, handle_ids,
        page_markdown_whole,
    )
}

_LONG = "|".join(f"/{i}-none$" for i in range(80))
SQL = {
    "sitemap_discovery": """WITH n AS (SELECT n_nationkey AS k, 'https://n' || n_nationkey || '.example.com' AS base FROM nation), found AS (
    SELECT k, CASE WHEN k % 4 <> 0 THEN base || '/sitemap.xml' WHEN k % 3 = 0 AND k <> 12 THEN base || '/sitemap.xml'
        WHEN k % 8 <> 0 THEN base || '/sitemap_index.xml' END AS url, CASE WHEN k % 4 <> 0 THEN 'robots' ELSE 'well-known' END AS source FROM n
) SELECT CASE WHEN k % 2 = 0 THEN 'https://n' || k || '.example.com/x' ELSE 'n' || k || '.example.com' END AS domain, url, source
    FROM found WHERE url IS NOT NULL""",
    "url_policy_allowlist": """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN c_custkey % 250 < 128 WHEN 1 THEN c_custkey % 9 = 5
    WHEN 2 THEN true ELSE false END AS allowed FROM customer""",
    "whois_referral": """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 3 = 0 THEN 'none'
    ELSE 'whois' || s_suppkey || '.example.com' END AS server FROM supplier""",
    "discovery_counts": """SELECT count(*) FILTER (WHERE p_partkey % 10 <> 5) AS sitemap_count, count(*) FILTER (WHERE p_partkey % 10 <> 5) AS page_link_count,
    2 * count(*) FILTER (WHERE p_partkey % 10 <> 5) AS total FROM part""",
    "crawl_first_pages": policy_queries.crawl_sql(9) + "SELECT url, depth, status FROM c ORDER BY depth, url LIMIT 25",
    "url_pattern_linear": f"""SELECT page_id, url FROM (SELECT page_id, url, {part('url', 5)} AS p FROM pages)
    WHERE (regexp_matches(p, '^/([a-z]+/)+') OR regexp_matches(p, '(foo|b+)*x9$'))
    AND NOT regexp_matches(p, '(?:[aeiou]{{2}})+[^/]*\\.html$') AND NOT regexp_matches(p, '{_LONG}')""",
    "handle_ids": "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 < 2 THEN p_partkey::VARCHAR ELSE 'none' END AS handle FROM part",
    "page_markdown_whole": content_queries.MARKDOWN_SQL
    + "SELECT page_id, array_to_string(links || list_filter(texts[:-2], lambda x: x <> ''), chr(10) || chr(10)) AS markdown FROM marked",
}
