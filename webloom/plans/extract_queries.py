"""Queries over rendered pages, feeds and sitemaps; their SQL reads the columns they are rendered from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import images, metadata
from webloom.plans.common import table
from webloom.sources import feeds, rendered


def meta_title_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.extract_metadata(table(spark, sf_dir, "pages")).select("page_id", "title", "language", "url")


def meta_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metadata.extract_metadata(rendered.og_pages(spark, sf_dir))
    return found.select("page_id", "title", "author", "description", "date_published", "url", "language", "site_name", "image")


def meta_opengraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.opengraph(rendered.og_pages(spark, sf_dir))


def org_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metadata.extract_org(rendered.og_pages(spark, sf_dir))
    return found.select(
        "page_id", "name", "legal_name", "org_type", "phone", "country", "postal_code", "jurisdiction", "registration_number",
        F.try_element_at("social", F.lit("linkedin")).alias("linkedin"), F.try_element_at("social", F.lit("github")).alias("github"),
    )


def org_title_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    separators = F.array(*[F.lit(s) for s in (" | ", " - ", " — ", " :: ", " » ", " ")])
    title = F.concat("s_name", F.element_at(separators, (F.col("s_suppkey") % 6 + 1).cast("int")), F.lit("Home page"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", metadata.title_name(title).alias("name"))


FORMS = ["Inc.", "LLC", "L.L.C.", "GmbH", "S.r.l.", "Corp.", "Ltd."]


def org_entity_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.element_at(F.array(*[F.lit(s) for s in FORMS]), (F.col("s_suppkey") % 7 + 1).cast("int"))
    text = F.when(F.col("s_suppkey") % 5 == 0, F.concat("s_name", F.lit(" LLCfoo"))).otherwise(F.concat("s_name", F.lit(" "), form, F.lit(" since")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", metadata.legal_text(text)["entity_form"].alias("entity_form"))


def images_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = images.extract_images(rendered.image_pages(spark, sf_dir))
    return found.select("page_id", "pos", "src", "alt", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("width", "height")], "image_type", "context", "format")


def images_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = images.extract_images(rendered.image_pages(spark, sf_dir))
    return found.groupBy("image_type").agg(F.count("*").alias("n"))


def srcset_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = images.extract_images(rendered.image_pages(spark, sf_dir))
    return found.select("page_id", F.explode("srcset").alias("s")).select("page_id", "s.url", "s.descriptor")


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feeds.parse_feeds(rendered.feed_docs(spark, sf_dir))
    return found.select(
        "feed_id", "format", "feed_title", "item", "title", "link", "description", "author", "guid",
        F.array_join("categories", ",").alias("categories"), F.col("published").cast("timestamp_ntz").alias("published"),
    )


def feed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feeds.parse_feeds(rendered.feed_docs(spark, sf_dir))
    return found.groupBy("format").agg(F.countDistinct("feed_id").alias("feeds"), F.count("item").alias("items"))


def sitemap_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feeds.sitemap_entries(rendered.sitemap_files(spark, sf_dir)).filter("NOT is_index")
    return found.select("url", "loc", F.col("lastmod").cast("timestamp_ntz").alias("lastmod"), "priority")


def sitemap_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text sitemaps, a line each page, with lines that aren't URLs."""
    lines = F.array_join(F.array_sort(F.collect_list("url")), "\r\n ")
    body = F.concat(F.lit("not a url\n\n"), lines, F.lit("\nftp://x/"))
    files = table(spark, sf_dir, "pages").groupBy((F.col("page_id") % 10).alias("k")).agg(body.alias("body"))
    files = files.select(F.concat(F.lit("https://t.example.com/"), "k").alias("url"), "body")
    return feeds.sitemap_entries(files).groupBy("url").agg(F.count("*").alias("n"), F.min("loc").alias("first_loc"))


def sitemap_index_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = rendered.sitemap_files(spark, sf_dir)
    start = spark.createDataFrame([("https://shop.example.com/root.xml",)], "url string")
    return feeds.resolve_sitemaps(files, start).groupBy("url", "depth").agg(F.count("*").alias("n"))


QUERIES = {
    "meta_title_lang": meta_title_lang,
    "meta_precedence": meta_precedence,
    "meta_opengraph": meta_opengraph,
    "org_entity": org_entity,
    "org_title_names": org_title_names,
    "org_entity_forms": org_entity_forms,
    "images_extract": images_extract,
    "images_by_type": images_by_type,
    "srcset_parse": srcset_parse,
    "feed_items": feed_items,
    "feed_summary": feed_summary,
    "sitemap_xml": sitemap_xml,
    "sitemap_text": sitemap_text,
    "sitemap_index_recursive": sitemap_index_recursive,
}

_IMAGES = """WITH i AS (
    SELECT p_partkey AS k, 1 AS pos, 'https://shop.example.com/img/' || p_partkey || '.jpg' AS src, p_name AS alt,
        p_size + 50 AS width, 60 AS height, 'content' AS image_type, p_brand AS context, 'jpg' AS format FROM part
    UNION ALL SELECT p_partkey, 2, 'https://shop.example.com/lazy/' || p_partkey || '.webp', p_type, NULL, NULL, 'content', p_type, 'webp' FROM part
    UNION ALL SELECT p_partkey, 3, 'https://shop.example.com/t/pixel.gif?p=' || p_partkey, NULL, 1, 1, 'tracking', '', 'gif' FROM part
    UNION ALL SELECT p_partkey, 4, 'https://shop.example.com/deco/' || p_partkey || '.svg', '', NULL, NULL, 'decorative', '', 'svg' FROM part
    UNION ALL SELECT p_partkey, 5, 'https://shop.example.com/logo/' || p_partkey || '.png', NULL, NULL, NULL, 'icon', p_name, 'png' FROM part
)
"""
SQL = {
    "meta_title_lang": r"""SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(
    regexp_extract(html, '<title>([^<]*)', 1), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g')), '') AS title,
    regexp_extract(html, '<html lang="([^"]*)"', 1) AS language, url FROM pages""",
    "meta_precedence": """SELECT c_custkey AS page_id,
    CASE WHEN c_custkey % 3 <> 0 THEN c_name || ' & Co' ELSE c_name || ' | ' || c_mktsegment END AS title,
    CASE WHEN c_custkey % 5 <> 0 THEN 'Ed ' || c_custkey END AS author, 'About ' || c_name AS description,
    CASE WHEN c_custkey % 5 <> 0 THEN '2024-01-02' END AS date_published, 'https://c' || c_custkey || '.example.com/' AS url,
    'en' AS language, c_mktsegment AS site_name, 'https://img.example.com/' || c_custkey || '.png' AS image
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "meta_opengraph": """SELECT c_custkey AS page_id, 'title' AS key, c_name || ' & Co' AS content FROM customer WHERE c_custkey % 3 <> 0
    UNION ALL SELECT c_custkey, 'site_name', c_mktsegment FROM customer
    UNION ALL SELECT c_custkey, 'image', 'https://img.example.com/' || c_custkey || '.png' FROM customer""",
    "org_entity": """SELECT c_custkey AS page_id, CASE WHEN ld THEN c_name ELSE c_mktsegment END AS name,
    CASE WHEN ld THEN c_name || ' LLC' END AS legal_name, CASE WHEN ld THEN 'Organization' END AS org_type,
    CASE WHEN ld THEN '+' || c_custkey END AS phone, CASE WHEN ld THEN n_name END AS country,
    CASE WHEN ld THEN c_custkey::VARCHAR END AS postal_code, 'Nevada' AS jurisdiction, c_custkey || '-77' AS registration_number,
    CASE WHEN ld THEN 'https://www.linkedin.com/c/' || c_custkey END AS linkedin,
    CASE WHEN ld THEN 'https://github.com/c' || c_custkey END AS github
    FROM (SELECT *, c_custkey % 5 <> 0 AS ld FROM customer) JOIN nation ON c_nationkey = n_nationkey""",
    "org_title_names": "SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 5 THEN s_name || ' Home page' ELSE s_name END AS name FROM supplier",
    "org_entity_forms": f"SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 THEN ({FORMS!r})[s_suppkey % 7 + 1] END AS entity_form FROM supplier",
    "images_extract": _IMAGES + "SELECT k AS page_id, pos, src, alt, coalesce(width, -1)::INTEGER AS width, coalesce(height, -1)::INTEGER AS height, image_type, context, format FROM i",
    "images_by_type": _IMAGES + "SELECT image_type, count(*) AS n FROM i GROUP BY image_type",
    "srcset_parse": "SELECT p_partkey AS page_id, 'https://shop.example.com/img/' || p_partkey || '-' || n || '.jpg' AS url,"
    " n || 'x' AS descriptor FROM part, (VALUES (1), (2)) v(n)",
    "feed_items": """SELECT o_custkey AS feed_id, CASE WHEN o_custkey % 2 = 0 THEN 'rss' ELSE 'atom' END AS format,
    'Feed ' || o_custkey AS feed_title, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INTEGER AS item,
    'Order ' || o_orderkey || ' & more' AS title, 'https://s.example.com/o/' || o_orderkey AS link, o_orderpriority AS description,
    o_orderstatus AS author, 'g' || o_orderkey AS guid, 'c' || (o_orderkey % 3) AS categories,
    date_trunc('second', o_orderdate) - INTERVAL 2 HOUR AS published FROM orders""",
    "feed_summary": """SELECT CASE WHEN o_custkey % 2 = 0 THEN 'rss' ELSE 'atom' END AS format, count(DISTINCT o_custkey) AS feeds,
    count(*) AS items FROM orders GROUP BY 1""",
    "sitemap_xml": """SELECT 'https://shop.example.com/' || p_brand || '.xml' AS url, 'https://shop.example.com/p/' || p_partkey AS loc,
    make_timestamp(2000 + p_partkey % 24, p_partkey % 9 + 1, 1, 0, 0, 0) AS lastmod,
    CASE WHEN p_partkey % 10 <> 0 THEN (p_partkey % 10) / 10.0::DOUBLE END AS priority FROM part""",
    "sitemap_text": """SELECT 'https://t.example.com/' || (page_id % 10) AS url, count(*) AS n, min(trim(url)) AS first_loc
    FROM pages GROUP BY page_id % 10""",
    "sitemap_index_recursive": """SELECT 'https://shop.example.com/' || p_brand || '.xml' AS url, 2 AS depth, count(*) AS n
    FROM part GROUP BY p_brand""",
}
