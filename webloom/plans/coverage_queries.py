"""Queries over links of every type, fetch routes, rendered content and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import fixed
from webloom.operators import fetch_policy, rendering
from webloom.operators.links import extract_links
from webloom.plans import content_queries, policy_queries
from webloom.plans.common import table
from webloom.sources import blocks, rendered


def links_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_links(rendered.link_pages(spark, sf_dir)).select("page_id", "pos", "url", "text", "rel", "is_internal", "link_type", "position")


def link_type_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_links(rendered.link_pages(spark, sf_dir))
    return found.groupBy("position").pivot("link_type", ["content", "navigation", "pagination", "social", "download", "anchor"]).count().na.fill(0)


def consent_banners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the banners of eight managers, and without one."""
    pages, html = rendered.link_pages(spark, sf_dir), F.col("html")
    for i, (attribute, value) in enumerate(fixed.CONSENT_MANAGERS.values()):
        own = f'class="x {value} y"' if attribute == "class" else f'{attribute}="{value}"'
        html = F.when(F.col("page_id") % 9 == i, F.replace("html", F.lit('id="onetrust-banner-sdk" class="x"'), F.lit(own))).otherwise(html)
    none = F.replace("html", F.lit('id="onetrust-banner-sdk"'), F.lit('id="onetrust-banner"'))
    return rendering.consent_managers(pages.withColumn("html", F.when(F.col("page_id") % 9 == 8, none).otherwise(html)))


def rendered_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered pages against empty shells."""
    shell = F.when(F.col("page_id") % 3 == 0, F.lit("<html><body><div id=root></div><script>app()</script></body></html>")).otherwise(
        F.concat(F.lit("<main>"), F.repeat(F.lit("text "), 50), F.lit("</main>"))
    )
    pages = table(spark, sf_dir, "pages").select("page_id", "url", shell.alias("html"))
    return rendering.is_rendered(pages)


def fetch_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = rendered.http_observations(spark, sf_dir)
    body = F.when(F.col("id") % 3 == 0, "<title>Just a moment...</title>").otherwise("<p>hello")
    route = rendering.fetch_route(F.col("status"), body, F.col("id") % 10 == 0)
    return seen.select(route.alias("route")).groupBy("route").agg(F.count("*").alias("n"))


def retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(".5"))).otherwise("Wed, 21 Oct 2015 07:28:00 GMT")
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(fetch_policy.retry_after(value), F.lit(-1.0)).alias("seconds"))


def port_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open, closed and silent ports of each host of recorded probes."""
    status = F.when(F.col("o_orderstatus") == "F", "open").when(F.col("o_orderstatus") == "O", "closed").otherwise("timeout")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("host"), status.alias("status"))
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return rows.groupBy("host").agg(count("open"), count("closed"), count("timeout"))


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, misses and hit rate over all keys of the cache fold."""
    events = table(spark, sf_dir, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), "ts")
    folded = fetch_policy.cache_hits(events, F.lit(3600.0)).agg(F.sum("n_hits").alias("hits"), F.sum(F.col("n_requests") - F.col("n_hits")).alias("misses"))
    return folded.withColumn("hit_rate", F.round(F.col("hits") / (F.col("hits") + F.col("misses")), 6))


def crawl_page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and links of each recorded page."""
    pages = table(spark, sf_dir, "pages")
    text = blocks.documents(blocks.blocks(pages, skip=("nav", "footer"))).select("page_id", "text")
    links = extract_links(pages).groupBy("page_id").agg(F.count("*").alias("link_count"))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long")
    return text.select("page_id", words.alias("word_count")).join(links, "page_id", "left")


def main_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.main_element(table(spark, sf_dir, "pages")).groupBy("tag").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        links_typed, link_type_matrix, consent_banners, rendered_content, fetch_routes, retry_after, port_status, cache_stats, crawl_page_summary, main_element,
    )
}

_LINKS = """WITH k AS (SELECT s_suppkey AS k, 'https://www.s' || s_suppkey || '.example.com' AS o FROM supplier), l AS (
    SELECT k AS page_id, 1 AS pos, o || '/home' AS url, 'Home' AS text, '' AS rel, true AS is_internal, 'navigation' AS link_type, 'header' AS position FROM k
    UNION ALL SELECT k, 2, o || '/l/' || k, '2', '', true, 'pagination', 'nav' FROM k
    UNION ALL SELECT k, 3, 'https://www.GitHub.com/s' || k, 'code', '', false, 'social', 'sidebar' FROM k
    UNION ALL SELECT k, 4, o || '/files/' || k || '.tar.gz?x=1', 'Get', '', true, 'download', 'body' FROM k
    UNION ALL SELECT k, 5, 'mailto:a' || k || '@example.com', 'Mail', '', true, 'content', 'body' FROM k
    UNION ALL SELECT k, 6, '#top', 'Top', '', true, 'anchor', 'body' FROM k
    UNION ALL SELECT k, 7, o || '/p/' || k, 'back', 'prev nofollow', true, 'pagination', 'body' FROM k
    UNION ALL SELECT k, 8, 'https://other.example.org/' || k, 'Pic', '', false, 'content', 'body' FROM k
    UNION ALL SELECT k, 9, o || '/imprint', 'Imprint', '', true, 'navigation', 'footer' FROM k
    UNION ALL SELECT k, 10, o || '/list?page=' || (k + 1), 'next', 'next', true, 'pagination', 'header' FROM k
)
"""
_STATUS = "[200, 301, 404, 429, 500, 503, 403, 204][c_custkey % 8 + 1]"
SQL = {
    "links_typed": _LINKS + "SELECT * FROM l",
    "link_type_matrix": _LINKS
    + "SELECT position, "
    + ", ".join(f"count(*) FILTER (WHERE link_type = '{t}') AS {t}" for t in ("content", "navigation", "pagination", "social", "download", "anchor"))
    + " FROM l GROUP BY position",
    "consent_banners": """SELECT s_suppkey AS page_id, ['OneTrust', 'CookieBot', 'TrustArc', 'Quantcast Choice', 'Complianz', 'Osano', 'Didomi', 'Termly'][s_suppkey % 9 + 1] AS manager
    FROM supplier WHERE s_suppkey % 9 < 8""",
    "rendered_content": "SELECT page_id, page_id % 3 <> 0 AS rendered FROM pages",
    "fetch_routes": f"""SELECT CASE WHEN c_custkey % 10 = 0 THEN 'browser' WHEN {_STATUS} = 403 OR ({_STATUS} = 200 AND c_custkey % 3 = 0)
    THEN 'http then browser' ELSE 'http' END AS route, count(*) AS n FROM customer GROUP BY 1""",
    "retry_after": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey + 0.5 ELSE -1.0 END::DOUBLE AS seconds FROM customer",
    "port_status": """SELECT o_custkey AS host, count(*) FILTER (WHERE o_orderstatus = 'F') AS open, count(*) FILTER (WHERE o_orderstatus = 'O') AS closed,
    count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS timeout FROM orders GROUP BY 1""",
    "cache_stats": "SELECT sum(n_hits)::BIGINT AS hits, sum(n_requests - n_hits)::BIGINT AS misses, round(sum(n_hits) / sum(n_requests), 6) AS hit_rate FROM ("
    + policy_queries.SQL["cache_hits"]
    + ")",
    "crawl_page_summary": content_queries.BODY_SQL
    + """, w AS (SELECT page_id, sum(len(string_split(text, ' ')))::BIGINT AS word_count FROM t WHERE text <> '' GROUP BY page_id)
    SELECT page_id, word_count, link_count FROM w LEFT JOIN (SELECT page_id, len(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1)))::BIGINT AS link_count
    FROM pages) USING (page_id)""",
}
