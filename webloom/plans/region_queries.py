"""Queries of regions beside the best, hand-set weights, breadths, ablation, odd pages, stores and answered streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import evaluation, readability, search
from webloom.plans.common import host, table
from webloom.runtime import checkpointed, ensure_checkpoint_dir
from webloom.sources import blocks, sinks
from webloom.sources.dom import nodes
from webloom.sources.rendered import text
from webloom.streaming import stateful
from webloom.streaming.runs import finished, recorded_stream

#: A paragraph of 330 characters with five commas.
PARAGRAPH = "word, " * 5 + "a" * 299 + "."


def story_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages of a story, a second container (every other one of the story's class) and a paragraph (every third long)."""
    key = F.col("p_partkey")
    story = '<html><body><div class="story">' + f"<p>{PARAGRAPH}</p>" * 6 + "</div>"
    second = F.when(key % 2 == 0, "story").otherwise("extra")
    last = F.when(key % 3 == 0, "b" * 100).otherwise("short")
    html = text(story, '<div class="', second, f'"><p>{PARAGRAPH}</p></div><p>', last, "</p></body></html>")
    return table(spark, sf_dir, "part").select(key.alias("page_id"), F.lit("https://example.com/").alias("url"), html.alias("html"))


def readability_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readability.heuristic_regions(story_pages(spark, sf_dir))
    return found.select("page_id", "tag", "is_best", F.round("score", 3).alias("score"))


def heuristic_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions of a narrow and of a wide breadth."""
    pages = story_pages(spark, sf_dir)
    found = checkpointed(nodes(pages))
    each = [readability.heuristic_regions(pages, found, s).select("page_id", F.lit(s).alias("scope")) for s in (0.0, 1.0)]
    return each[0].unionByName(each[1]).groupBy("page_id", "scope").agg(F.count("*").alias("n"))


def hand_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tags of pages score by hand-set weights."""
    rows = readability.content_features(checkpointed(nodes(table(spark, sf_dir, "pages")))).withColumn("p", readability.hand_probability())
    return rows.groupBy("tag").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("probability"))


def content_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the content model loses without each group of features, trained on one half of the pages and told on the other."""
    found = checkpointed(nodes(table(spark, sf_dir, "pages")))
    rows = evaluation.label_nodes(
        readability.content_features(found),
        found.filter("tag = 'article'").select("page_id", F.col("nid").alias("root")),
        found.filter("tag IN ('nav', 'footer')").select("page_id", F.col("nid").alias("root")),
    )
    told = evaluation.ablation(checkpointed(rows.withColumn("fold", F.col("page_id") % 2)), "fold", [0, 1])
    return told.select(F.coalesce("dropped", F.lit("none")).alias("dropped"), *[F.round(c, 6).alias(c) for c in ("f1", "top_hit_rate", "delta_f1")])


def prose_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages whose pre holds prose."""
    html = text("<pre>A ", F.col("p_name"), "\n  ", F.col("p_type"), "\n\n \nB ", F.col("p_brand"), "\n</pre><p>end</p>")
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.lit("https://example.com/").alias("url"), html.alias("html"))
    return blocks.blocks(pages, prose=True).select("page_id", "block_idx", "node_type", "text")


def ixbrl_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as reports, all but every third in inline XBRL."""
    key, size = F.col("p_partkey"), F.col("p_size")
    report = text(
        '<html xmlns:ix="http://www.xbrl.org/2013/inlineXBRL"><body><ix:header>\n<ix:hidden><p>hidden ', size, "</p></ix:hidden></ix:header>",
        '<p>Revenue of <ix:nonFraction name="r" contextRef="c">', size, "</ix:nonFraction> dollars</p></body></html>",
    )
    html = F.when(key % 3 != 0, report).otherwise(text("<p>Revenue of ", size, " dollars</p>"))
    pages = table(spark, sf_dir, "part").select(key.alias("page_id"), F.lit("https://example.com/").alias("url"), html.alias("html"))
    return blocks.documents(blocks.blocks(pages)).select("page_id", "text")


def search_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.term_frequency(search.passages(table(spark, sf_dir, "documents")), "The ouea de THE la", top_k=3)
    return found.select("doc_id", "pos", "rank", F.col("score").cast("long").alias("hits"))


def stream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests; two thirds are answered some minutes later, not all in time."""
    events = recorded_stream(spark, sf_dir, "events")
    late = F.expr("timestampadd(MINUTE, event_id % 7, ts)")
    answers = recorded_stream(spark, sf_dir, "events").filter("event_id % 3 <> 0")
    found = stateful.answered(
        events.select(F.col("event_id").alias("id"), "ts"),
        answers.select(F.col("event_id").alias("id"), late.alias("ts"), F.lit(200).alias("status")),
    )
    return finished(found).select("id", "status", (F.unix_timestamp("r_ts") - F.unix_timestamp("ts")).alias("waited"))


def _folder(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/sink-{uuid.uuid4().hex}"


def keyed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written to a keyed store and read back."""
    path = _folder(spark)
    sinks.write_store(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("value")), path)
    return sinks.read_store(spark, path)


def written_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as JSON by host and read back."""
    path = _folder(spark)
    sinks.write_documents(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("text")), path, "json")
    rows = spark.read.schema("page_id long, url string, text string, host string").json(path)
    return rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (
        readability_siblings, heuristic_breadth, hand_weights, content_ablation, prose_blocks, ixbrl_text, search_frequency, stream_answers,
        keyed_store, written_documents,
    )
}

SQL = {
    "readability_siblings": """SELECT p_partkey AS page_id, 'div' AS tag, true AS is_best, 84.0::DOUBLE AS score FROM part
    UNION ALL SELECT p_partkey, 'div', false, 55.8 FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT p_partkey, 'p', false, 0.0 FROM part WHERE p_partkey % 3 = 0""",
    "heuristic_breadth": """SELECT p_partkey AS page_id, scope::DOUBLE AS scope,
    1 + (p_partkey % 2 = 0 OR scope = 1)::INT + (p_partkey % 3 = 0)::INT::BIGINT AS n FROM part, (VALUES (0), (1)) v(scope)""",
    "prose_blocks": """SELECT p_partkey AS page_id, i::INTEGER AS block_idx, 'Paragraph' AS node_type,
    CASE i WHEN 0 THEN 'A ' || p_name || ' ' || p_type WHEN 1 THEN 'B ' || p_brand ELSE 'end' END AS text FROM part, (VALUES (0), (1), (2)) v(i)""",
    "ixbrl_text": "SELECT p_partkey AS page_id, 'Revenue of ' || p_size || ' dollars' AS text FROM part",
    "search_frequency": r"""WITH p AS (
    SELECT doc_id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS text FROM (SELECT doc_id, string_split_regex(text, '\n+') AS parts FROM documents)
), s AS (
    SELECT doc_id, pos, len(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x IN ('de', 'la', 'ouea', 'the'))) AS hits FROM p
), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, pos) AS rank FROM s WHERE hits > 0)
SELECT doc_id, pos::INTEGER AS pos, rank::INTEGER AS rank, hits FROM r WHERE rank <= 3""",
    "stream_answers": """SELECT event_id AS id, 200 AS status, event_id % 7 * 60 AS waited FROM events
    WHERE event_id % 3 <> 0 AND event_id % 7 <= 5""",
    "keyed_store": "SELECT c_custkey::VARCHAR AS key, c_name AS value FROM customer",
    "written_documents": f"SELECT {host('url')} AS host, count(*) AS n, sum(length(html))::BIGINT AS chars FROM pages GROUP BY 1",
}
