"""Queries of recorded files: sitemaps with their errors, packed files, pages, and feeds polled as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import domain_intel, metadata, rendering
from webloom.plans import content_queries
from webloom.plans.common import table
from webloom.runtime import checkpointed, ensure_checkpoint_dir
from webloom.sources import blocks, feeds, files, rendered
from webloom.sources.rendered import text
from webloom.streaming import polls


def _folder(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/records-{uuid.uuid4().hex}"


def sitemap_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sitemaps of each nation: an index with good, broken, large, missing and circular files, and a chain of indexes that is too deep."""
    k = F.col("n_nationkey")
    nations = table(spark, sf_dir, "nation")
    at = lambda name: text("https://n", k, ".example.com/", name)
    lines = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.array_join(F.sort_array(F.collect_list(text("https://c.example.com/", F.col("c_custkey"), "\n"))), "").alias("body")
    )
    lines = checkpointed(lines)
    # The bound tells the large file from the others, so it isn't below the longest list of customers.
    longest = lines.agg(F.max(F.octet_length("body"))).first()[0] or 0
    most = max(1_000_000, longest)
    index = lambda *names: F.concat(F.lit("<sitemapindex>"), *[text("<sitemap><loc>", at(n), "</loc></sitemap>") for n in names], F.lit("</sitemapindex>"))
    bodies = {
        "index.xml": index("customers.xml", "broken.xml.gz", "large.txt", "gone.xml", "index.xml", "d1.xml").cast("binary"), "broken.xml.gz": F.unhex(F.lit("1F8B08000000")),
        "large.txt": F.repeat(F.lit("x"), most + 100_000).cast("binary"), "d1.xml": index("d2.xml", "customers.xml").cast("binary"), "d2.xml": index("d3.xml").cast("binary"), "d3.xml": index("d4.xml").cast("binary"),
        "d4.xml": F.lit("<urlset/>").cast("binary"),
    }
    known = nations.select(F.explode(F.array(*[F.struct(at(n).alias("url"), b.alias("packed")) for n, b in bodies.items() if n != "large.txt"])).alias("f")).select("f.*")
    known = known.unionByName(nations.filter(k % 5 == 0).select(at("large.txt").alias("url"), bodies["large.txt"].alias("packed")))
    known = known.unionByName(lines.select(at("customers.xml").alias("url"), F.col("body").cast("binary").alias("packed")))
    _, visits = feeds.sitemap_tree(known, nations.select(at("index.xml").alias("url")), max_depth=3, most=most)
    return visits.select("url", "depth", F.coalesce("error", F.lit("none")).alias("error"), F.coalesce("n", F.lit(-1)).alias("n"))


def recorded_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each size as a sitemap file, packed for even sizes, written, read back and parsed."""
    path = _folder(spark)
    lines = table(spark, sf_dir, "part").select(F.col("p_size").alias("size"), text("https://shop.example.com/p/", F.col("p_partkey")).alias("value"))
    for rest, codec in ((0, "gzip"), (1, "none")):
        dealt = lines.filter(F.col("size") % 2 == rest).repartition("size")
        dealt.write.partitionBy("size").option("compression", codec).text(f"{path}/{codec}")
    entries, visits = files.sitemap_files(spark, path, "part-*")
    size = F.regexp_extract("url", r"/size=(\d+)/", 1).cast("int").alias("size")
    told = entries.groupBy(size).agg(F.count("*").alias("n"), F.min("loc").alias("first_loc"))
    return told.join(visits.groupBy(size).agg(F.count_if(F.col("error").isNotNull()).alias("errors")), "size")


def recorded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each nation written as a file and read back, with its title and text."""
    path = _folder(spark)
    n = F.col("n_nationkey")
    html = text("<html><head><title>", F.col("n_name"), " é</title></head><body><p>Region ", F.col("n_regionkey"), "</p></body></html>")
    table(spark, sf_dir, "nation").select(n.alias("nation"), html.alias("value")).repartition("nation").write.partitionBy("nation").text(path)
    found = files.html_files(spark, path, "part-*").withColumn("nation", F.regexp_extract("url", r"/nation=(\d+)/", 1).cast("int"))
    pages = found.select(F.col("nation").cast("long").alias("page_id"), "url", "html")
    texts = blocks.documents(blocks.blocks(pages)).select("page_id", "text")
    titles = metadata.extract_metadata(pages).select("page_id", "title")
    return titles.join(texts, "page_id").join(found.select(F.col("nation").cast("long").alias("page_id"), "charset"), "page_id")


def feed_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three polls of the customers' feeds, each of which repeats what came before; some items come a poll too late."""
    path = _folder(spark)
    orders, late = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 97 == 0
    for until, more in (("1997-01-01", ~late), ("1999-01-01", ~late), ("2100-01-01", F.lit(True))):
        rendered.feed_docs(spark, sf_dir, orders.filter((F.col("o_orderdate") < until) & more)).write.mode("append").parquet(f"{path}/in")
        polls.poll(spark, f"{path}/in", f"{path}/out")
    return polls.polled(spark, f"{path}/out").select("feed_id", "guid", F.col("published").cast("timestamp_ntz").alias("published"))


def whois_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders in eight of the registries' formats."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    shapes = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss'+0200'", "E MMM dd HH:mm:ss 'UTC' yyyy", "dd-MMM-yyyy", "yyyy.MM.dd", "yyyy-MM-dd'T'HH:mm:ss.'250Z'", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss '(-0330)'"]
    said = F.date_format(day, shapes[-1])
    for i, shape in enumerate(shapes[:-1]):
        said = F.when(k % 8 == i, F.date_format(day, shape)).otherwise(said)
    return table(spark, sf_dir, "orders").select(k.alias("id"), domain_intel.whois_date(F.concat(F.lit("before "), said, F.lit("."))).alias("date"))


def article_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of the main element of each page."""
    return blocks.documents(rendering.article_blocks(table(spark, sf_dir, "pages"))).select("page_id", "text")


QUERIES = {f.__name__: f for f in (sitemap_sources, recorded_sitemaps, recorded_pages, feed_polls, whois_dates, article_documents)}

SQL = {
    "sitemap_sources": """WITH n AS (SELECT n_nationkey AS k, 'https://n' || n_nationkey || '.example.com/' AS o FROM nation), c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), v AS (
    SELECT k, 'index.xml' AS f, 0 AS depth, 'none' AS error, 6 AS n FROM n UNION ALL SELECT k, 'broken.xml.gz', 1, 'broken', -1 FROM n
    UNION ALL SELECT k, 'large.txt', 1, CASE WHEN k % 5 = 0 THEN 'too large' ELSE 'missing' END, -1 FROM n UNION ALL SELECT k, 'gone.xml', 1, 'missing', -1 FROM n
    UNION ALL SELECT k, 'index.xml', 1, 'again', -1 FROM n UNION ALL SELECT k, 'd1.xml', 1, 'none', 2 FROM n UNION ALL SELECT k, 'd2.xml', 2, 'none', 1 FROM n
    UNION ALL SELECT k, 'd3.xml', 3, 'none', 1 FROM n UNION ALL SELECT k, 'd4.xml', 4, 'too deep', -1 FROM n
    UNION ALL SELECT n.k, 'customers.xml', 1, CASE WHEN c.n IS NULL THEN 'missing' ELSE 'none' END, coalesce(c.n, -1) FROM n LEFT JOIN c USING (k) UNION ALL SELECT k, 'customers.xml', 2, 'again', -1 FROM n
) SELECT o || f AS url, depth::INTEGER AS depth, error, n::BIGINT AS n FROM v JOIN n USING (k)""".replace("FROM v JOIN n USING (k)", "FROM v JOIN (SELECT k, o FROM n) USING (k)"),
    "recorded_sitemaps": """SELECT p_size AS size, count(*) AS n, min('https://shop.example.com/p/' || p_partkey) AS first_loc, 0::BIGINT AS errors FROM part GROUP BY p_size""",
    "recorded_pages": """SELECT n_nationkey::BIGINT AS page_id, n_name || ' é' AS title, 'Region ' || n_regionkey AS text, 'utf-8' AS charset FROM nation""",
    "feed_polls": """WITH o AS (SELECT o_custkey AS feed_id, 'g' || o_orderkey AS guid, o_orderkey % 97 = 0 AS late, o_orderdate AS d, date_trunc('second', o_orderdate) - INTERVAL 2 HOUR AS published FROM orders),
    w AS (SELECT max(published) - INTERVAL 7 DAY AS mark FROM o WHERE NOT late AND d < TIMESTAMP '1999-01-01')
    SELECT feed_id, guid, published FROM o, w WHERE NOT late OR published > mark""",
    "whois_dates": """SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN t WHEN 1 THEN t || '+02:00' WHEN 2 THEN t WHEN 5 THEN t || '.250000' WHEN 7 THEN t || '-03:30' ELSE d || 'T00:00:00' END AS date
    FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS t, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)""",
    # An article of fewer than 40 characters is no region, so its page is taken whole.
    "article_documents": content_queries.BLOCKS_SQL
    + """, whole AS (SELECT page_id, generate_subscripts(parts, 1) AS n, unnest(parts) AS raw FROM (SELECT page_id, string_split_regex(replace(regexp_replace(regexp_replace(html,
        '(?s)<!DOCTYPE[^>]*>|<head>.*?</head>|<!--.*?-->', '', 'g'), '</?b>', '', 'g'), '<br>', ' '), '(?s)<[^<>]*>') AS parts FROM pages)
    ), u AS (SELECT page_id, n, trim(regexp_replace("""
    + content_queries._UNESCAPE.format("raw")
    + r""", '\s+', ' ', 'g')) AS text FROM whole), short AS (SELECT page_id FROM t WHERE text <> '' GROUP BY page_id HAVING sum(length(text)) < 40)
    SELECT page_id, string_agg(text, chr(10) || chr(10) ORDER BY n) AS text FROM (SELECT page_id, n, text FROM t WHERE page_id NOT IN (FROM short)
    UNION ALL SELECT page_id, n, text FROM u WHERE page_id IN (FROM short)) WHERE text <> '' GROUP BY page_id""",
}
