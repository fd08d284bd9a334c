"""Queries of content extraction: readability, blocks, tables, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import readability, search
from webloom.plans.common import table
from webloom.runtime import checkpointed
from webloom.sources import blocks, rendered
from webloom.sources.dom import nodes


def semantic_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readability.semantic_container(table(spark, sf_dir, "pages"))
    return found.select("page_id", "tag")


def link_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link density of each page's navigation and article."""
    found = nodes(table(spark, sf_dir, "pages"), ["nav", "article"])
    return found.select("page_id", "tag", F.round(readability.link_density(), 6).alias("density"))


def readability_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readability.heuristic_regions(table(spark, sf_dir, "pages")).filter("is_best")
    return found.select("page_id", "tag", F.round("score", 3).alias("score"))


def learned_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readability.learned_regions(table(spark, sf_dir, "pages")).filter("role = 'core'")
    return found.groupBy("tag").agg(F.count("*").alias("n"))


def learned_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readability.content_features(checkpointed(nodes(table(spark, sf_dir, "pages")))).withColumn("p", readability.content_probability())
    return rows.groupBy("tag").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("probability"), F.round(F.avg("f_depth"), 6).alias("depth"))


def content_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions for a narrow, the usual and a wide breadth."""
    pages = table(spark, sf_dir, "pages")
    found = checkpointed(nodes(pages))
    scored = checkpointed(readability.scored_features(found))
    parts = [readability.learned_regions(pages, s, found, scored).withColumn("scope", F.lit(s)) for s in (0.0, 0.5, 1.0)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("scope", "tag", "role").agg(F.count("*").alias("n"))


def blocks_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.blocks(table(spark, sf_dir, "pages"), skip=("nav", "footer"))
    return found.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if(F.col("node_type") == "Heading").alias("headings"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.documents(blocks.blocks(table(spark, sf_dir, "pages"), skip=("nav", "footer")))
    return found.select("page_id", "text")


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole markdown of whole pages."""
    return blocks.documents(blocks.blocks(table(spark, sf_dir, "pages"))).select("page_id", "markdown")


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.cells(rendered.table_pages(spark, sf_dir)).filter("row > 0")
    return found.select("page_id", "row", "col", "text")


def table_column_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.column_types(blocks.cells(rendered.table_pages(spark, sf_dir)))
    return found.groupBy("name", "type").agg(F.count("*").alias("n"))


def search_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = search.passages(table(spark, sf_dir, "documents"))
    found = search.bm25(parts, "The ouea de THE la", top_k=3)
    return found.select("doc_id", "pos", "rank", F.round("score", 6).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        semantic_container, link_density, readability_heuristic, learned_core, learned_features, content_scope, blocks_extract, page_text,
        page_markdown, table_cells, table_column_types, search_passages,
    )
}

#: A title may be cut inside a reference; HTML decodes &amp without its semicolon.
_UNESCAPE = "replace(regexp_replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;?', '&', 'g'), chr(160), ' ')"
_ARTICLE = r"""regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1), '(?s)<[A-Za-z/!][^<>]*$', '')"""
BLOCKS_SQL = rf"""WITH b AS (
    SELECT page_id, generate_subscripts(parts, 1) AS n, unnest(parts) AS raw FROM (
        SELECT page_id, string_split_regex(replace(regexp_replace({_ARTICLE}, '</?b>', '', 'g'), '<br>', ' '), '(?s)<[^<>]*>') AS parts FROM pages)
), t AS (SELECT page_id, n, trim(regexp_replace({_UNESCAPE.format("raw")}, '\s+', ' ', 'g')) AS text, {_UNESCAPE.format("raw")} AS plain FROM b)
"""
#: Whole pages but for their heads, menus and footers.
_BODY = r"""regexp_replace(regexp_replace(html, '(?s)<!DOCTYPE[^>]*>|<head>.*?</head>|<nav>.*?</nav>|<footer>.*?(</footer>|$)|<!--.*?-->', '', 'g'), '(?s)<[A-Za-z/!][^<>]*$', '')"""
BODY_SQL = BLOCKS_SQL.replace(_ARTICLE, _BODY)
#: Markdown of the pages: menu, advert, article and, last, footer, as lists of blocks.
MARKDOWN_SQL = r"""WITH cut AS (
    SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+') AS root, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav,
        regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) AS advert, regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1) AS footer,
        regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1), '(?s)<[A-Za-z/!][^<>]*$', '') AS body
    FROM pages
), parts AS (
    SELECT page_id, list_transform(list_zip(regexp_extract_all(nav, '<a href="([^"]*)">([^<]*)</a>', 1), regexp_extract_all(nav, '<a href="([^"]*)">([^<]*)</a>', 2)),
            lambda x: '- [' || trim(x[2]) || '](' || root || x[1] || ')') AS links,
        [advert] || string_split_regex(replace(body, '</h1>', '<p>'), '(</?p>)+') || [footer] AS texts
    FROM cut
), plain AS (
    SELECT page_id, links, list_transform(texts, lambda x: CASE WHEN starts_with(x, '<h1>') THEN '# ' WHEN starts_with(x, '<b>') THEN '**' ELSE '' END) AS marks,
        list_transform(texts, lambda x: trim(regexp_replace(replace(regexp_replace(replace(replace(replace(regexp_replace(x, '<[^<>]*>', ' ', 'g'),
            '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g'), chr(160), ' '), '\s+', ' ', 'g'))) AS texts FROM parts
), marked AS (
    SELECT page_id, links, list_transform(list_zip(marks, texts), lambda x: CASE WHEN x[2] = '' THEN ''
        WHEN x[1] = '**' THEN '**' || x[2] || '**' ELSE x[1] || x[2] END) AS texts FROM plain
)
"""
SQL = {
    "semantic_container": BLOCKS_SQL
    + """SELECT page_id, 'article' AS tag FROM t WHERE text <> '' GROUP BY page_id HAVING sum(len(string_split(text, ' '))) >= 50""",
    "link_density": "SELECT page_id, tag, CASE tag WHEN 'nav' THEN 1.0 ELSE 0.0 END::DOUBLE AS density FROM pages, (VALUES ('nav'), ('article')) v(tag)",
    "readability_heuristic": BLOCKS_SQL
    + r"""SELECT page_id, 'article' AS tag, round(5.0 + sum(1 + length(body) - length(replace(body, ',', '')) + least(length(body) // 100, 3)), 3)::DOUBLE AS score
    FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) AS k, regexp_replace(plain, '^\s+|\s+$', '', 'g') AS body FROM t WHERE text <> '')
    WHERE k > 1 AND length(body) >= 25 GROUP BY page_id""",
    "blocks_extract": BLOCKS_SQL + "SELECT page_id, count(*) + 1 AS n, 1::BIGINT AS headings FROM t WHERE text <> '' GROUP BY page_id",
    "page_text": BODY_SQL + "SELECT page_id, string_agg(text, chr(10) || chr(10) ORDER BY n) AS text FROM t WHERE text <> '' GROUP BY page_id",
    "page_markdown": MARKDOWN_SQL + "SELECT page_id, array_to_string(links || list_filter(texts, lambda x: x <> ''), chr(10) || chr(10)) AS markdown FROM marked",
    "table_cells": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
    SELECT o_custkey AS page_id, n::INTEGER AS row, 0 AS col, o_orderkey::VARCHAR AS text FROM o
    UNION ALL SELECT o_custkey, n::INTEGER, 1, o_orderstatus FROM o
    UNION ALL SELECT o_custkey, n::INTEGER, 2, o_totalprice::DECIMAL(18, 2)::VARCHAR FROM o""",
    "table_column_types": """SELECT name, type, count(DISTINCT o_custkey) AS n FROM orders,
    (VALUES ('key', 'integer'), ('status', 'text'), ('price', 'float')) v(name, type) GROUP BY ALL""",
    "search_passages": r"""WITH p AS (
    SELECT doc_id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS text FROM (SELECT doc_id, string_split_regex(text, '\n+') AS parts FROM documents)
), w AS (
    SELECT doc_id, pos, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM p WHERE trim(text) <> ''
), c AS (
    SELECT doc_id, pos, len(words) AS n, len(list_filter(words, lambda x: x = 'de')) AS t0, len(list_filter(words, lambda x: x = 'la')) AS t1,
        len(list_filter(words, lambda x: x = 'ouea')) AS t2, len(list_filter(words, lambda x: x = 'the')) AS t3 FROM w
), d AS (
    SELECT *, count(*) OVER d AS m, avg(n) OVER d AS mean, sum((t0 > 0)::INT) OVER d AS d0, sum((t1 > 0)::INT) OVER d AS d1,
        sum((t2 > 0)::INT) OVER d AS d2, sum((t3 > 0)::INT) OVER d AS d3 FROM c WINDOW d AS (PARTITION BY doc_id)
), s AS (
    SELECT doc_id, pos, """
    + " + ".join(f"ln(1 + (m - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(4))
    + """ AS score FROM d
), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, pos) AS rank FROM s WHERE score > 0)
SELECT doc_id, pos::INTEGER AS pos, rank::INTEGER AS rank, round(score, 6) AS score FROM r WHERE rank <= 3""",
}
