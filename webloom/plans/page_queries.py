"""Queries over recorded pages: node table, links, semantic containers, readability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import fixed
from webloom.operators.links import extract_links, filter_links
from webloom.plans.common import host, part, table
from webloom.sources import bodies
from webloom.sources.dom import nodes

_HREFS = """
WITH a AS (
    SELECT page_id, url AS page_url, generate_subscripts(m, 1) AS n, unnest(m) AS tag FROM (
        SELECT page_id, url, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS m FROM pages)
), h AS (
    SELECT page_id, page_url, n, regexp_extract(tag, 'href="([^"]*)"', 1) AS href,
        replace(regexp_extract(tag, '>([^<]*)<', 1), '&amp;', '&') AS text FROM a
), l AS (
    SELECT page_id, min(n) AS n, ORIGIN || href AS url, arg_min(trim(text), n) AS text FROM h GROUP BY page_id, ORIGIN || href
)
""".replace("ORIGIN", f"({part('page_url', 2)} || '://' || {part('page_url', 4)})")


def links_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = extract_links(table(spark, sf_dir, "pages"))
    return links.select("page_id", "pos", "url", "text", "is_internal", "link_type", "position")


def links_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = extract_links(table(spark, sf_dir, "pages"))
    return links.groupBy("position", "link_type").agg(
        F.count("*").alias("n_links"), F.countDistinct("page_id").alias("n_pages")
    )


def links_internal_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = filter_links(extract_links(table(spark, sf_dir, "pages")), "navigation", internal_only=True)
    return links.groupBy("page_id").agg(F.count("*").alias("n"), F.max(F.length("text")).cast("long").alias("longest"))


def node_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(table(spark, sf_dir, "pages")).filter(F.col("tag").isin("nav", "ul", "li", "a", "article", "h1", "p", "div", "footer")).groupBy(
        "tag"
    ).agg(F.count("*").alias("n"))


def node_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links inside each navigation block, by the interval join of the node table."""
    found = nodes(table(spark, sf_dir, "pages"), ["nav", "a"])
    outer = found.filter("tag = 'nav'").select("page_id", F.col("nid").alias("first"), F.col("last_desc").alias("last"))
    inner = found.filter("tag = 'a'").select("page_id", "nid")
    held = outer.join(inner, "page_id").filter("nid > first AND nid <= last")
    return held.groupBy("page_id").agg(F.count("*").alias("n"))


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch totals: a page counts as fetched whole if it ends with its end tag."""
    pages = table(spark, sf_dir, "pages")
    whole = F.col("html").endswith("</html>")
    return pages.agg(
        F.count("*").alias("total"), F.count_if(whole).alias("succeeded"), F.count_if(~whole).alias("failed")
    )


def body_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages over a body cap of 5000 bytes."""
    large = table(spark, sf_dir, "pages").filter(bodies.body_error(F.col("html"), 5000).isNotNull())
    return large.select("page_id", F.octet_length("html").cast("long").alias("n_bytes"))


def bot_challenge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Challenge pages, of which some are planted."""
    planted = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("<title>Just a Moment...</title>"), F.col("html")))
    head = F.lower(F.substring(F.coalesce(planted, F.col("html")), 1, 8192))
    hit = F.lit(False)
    for mark in fixed.BOT_CHALLENGES:
        hit = hit | head.contains(mark)
    return table(spark, sf_dir, "pages").select("page_id", hit.alias("challenged"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, sentences and commas of documents."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.regexp_count(text, F.lit("[^ \t\n\r\x0b\x0c]+")).cast("long").alias("words"),
        F.regexp_count(text, F.lit("[.!?]+")).cast("long").alias("sentences"),
        (F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))).cast("long").alias("commas"),
    )


QUERIES = {
    "links_extract": links_extract,
    "links_by_position": links_by_position,
    "links_internal_navigation": links_internal_navigation,
    "node_tag_counts": node_tag_counts,
    "node_containment": node_containment,
    "page_outcomes": page_outcomes,
    "body_cap": body_cap,
    "bot_challenge": bot_challenge,
    "word_counts": word_counts,
}

_PAGED = "regexp_matches(text, '(?i)^(next|prev|previous|newer|older|»|«|›|‹|>>|<<|[0-9]+)$')"
_DOWNLOAD = " OR ".join(f"ends_with(lower({part('url', 5)}), '{e}')" for e in fixed.DOWNLOAD_ENDINGS)
_TYPED = f"""typed AS (
    SELECT *, CASE WHEN {_PAGED} THEN 'pagination'
        WHEN {host('url')} IN ({', '.join(map(repr, fixed.SOCIAL_HOSTS))}) THEN 'social'
        WHEN {_DOWNLOAD} THEN 'download' ELSE 'navigation' END AS link_type FROM l
)"""
SQL = {
    "links_extract": _HREFS
    + ", "
    + _TYPED
    + """SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n)::INTEGER AS pos, url, text,
    true AS is_internal, link_type, 'nav' AS position FROM typed""",
    "links_by_position": _HREFS
    + ", "
    + _TYPED
    + """SELECT 'nav' AS position, link_type, count(*) AS n_links, count(DISTINCT page_id) AS n_pages
    FROM typed GROUP BY link_type""",
    "links_internal_navigation": _HREFS
    + ", "
    + _TYPED
    + """SELECT page_id, count(*) AS n, max(length(text)) AS longest FROM typed
    WHERE link_type = 'navigation' GROUP BY page_id""",
    "node_tag_counts": """SELECT tag, sum(len(regexp_extract_all(html, '<' || tag || '[ >]')))::BIGINT AS n
    FROM pages, (SELECT unnest(['nav', 'ul', 'li', 'a', 'article', 'h1', 'p', 'div', 'footer']) AS tag)
    GROUP BY tag""",
    "node_containment": "SELECT page_id, n FROM (SELECT page_id, len(regexp_extract_all(html, '<a '))::BIGINT AS n"
    " FROM pages) WHERE n > 0",
    "page_outcomes": "SELECT count(*) AS total, count(*) FILTER (WHERE ends_with(html, '</html>')) AS succeeded,"
    " count(*) FILTER (WHERE NOT ends_with(html, '</html>')) AS failed FROM pages",
    "body_cap": "SELECT page_id, strlen(html)::BIGINT AS n_bytes FROM pages WHERE strlen(html) > 5000",
    "bot_challenge": "SELECT page_id, page_id % 7 = 0 OR ("
    + " OR ".join(f"contains(lower(substr(html, 1, 8192)), '{m}')" for m in fixed.BOT_CHALLENGES)
    + ") AS challenged FROM pages",
    "word_counts": r"""SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\r\x0b\x0c]+'))::BIGINT AS words,
    len(regexp_extract_all(text, '[.!?]+'))::BIGINT AS sentences,
    (length(text) - length(replace(text, ',', '')))::BIGINT AS commas FROM documents""",
}
