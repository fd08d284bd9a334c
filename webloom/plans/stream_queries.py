"""Queries that run streams to their end, and evaluations."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import wire
from webloom.operators import evaluation, readability
from webloom.plans import policy_queries
from webloom.plans.common import table
from webloom.runtime import checkpointed
from webloom.sources import search_results
from webloom.sources.dom import nodes
from webloom.sources.rendered import text
from webloom.streaming import stateful
from webloom.streaming.runs import finished, recorded_stream


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stateful.windowed_counts(recorded_stream(spark, sf_dir, "events"), "event_type", width="1 day")
    return finished(counts, "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = recorded_stream(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "ts")
    told = finished(stateful.rate_limited(requests, rate=0.001, burst=2))
    return told.groupBy("key").agg(F.count("*").alias("n_requests"), F.count_if(F.col("wait") > 0).alias("n_waited"), F.round(F.sum("wait"), 3).alias("total_wait"))


def stream_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = recorded_stream(spark, sf_dir, "events")
    requests = events.select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), "ts", F.lit(3600.0).alias("ttl"))
    return finished(stateful.cached(requests)).groupBy("key").agg(F.count("*").alias("n_requests"), F.count_if("hit").alias("n_hits"))


def stream_new_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as items of which one a user and type is new."""
    items = recorded_stream(spark, sf_dir, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("guid"), F.col("ts").alias("published"))
    return finished(stateful.new_items(items, late="20000 days")).agg(F.count("*").alias("n"), F.countDistinct("guid").alias("guids"))


def label_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long documents taken for good ones, held against the labels."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    found = evaluation.confusion(rows, F.col("quality") == 1, F.col("n_chars") >= 1000, ["lang"])
    return found.select("lang", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


def content_model_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A content model trained on the article and navigation elements of pages, scored on other pages."""
    found = checkpointed(nodes(table(spark, sf_dir, "pages")))
    rows = evaluation.label_nodes(
        readability.content_features(found),
        found.filter("tag = 'article'").select("page_id", F.col("nid").alias("root")),
        found.filter("tag IN ('nav', 'footer')").select("page_id", F.col("nid").alias("root")),
    )
    scored = evaluation.leave_one_out(checkpointed(rows.withColumn("fold", F.col("page_id") % 2)), "fold", [0, 1], iterations=30)
    return evaluation.confusion(scored, F.col("label") == 1, F.col("guess") == 1).select("tp", "fp", "fn", "tn")


def search_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded answers of four services, rendered from suppliers."""
    k = F.col("s_suppkey")
    item = lambda title, url, snippet, n: text('{"title":"', title, '","', url, '":"https://r.example.com/', k, "/", F.lit(n), '",', snippet, "}")
    name = F.col("s_name")
    serp = text('{"answer_box":{"title":"box","link":"https://b.example.com/","answer":"', k, '"},"organic_results":[', item(name, "link", '"snippet":"s"', 1), ",", item(name, "link", '"position":7,"snippet":"t"', 2), "]}")
    exa = text('{"results":[', item(name, "url", '"highlights":["h","i"]', 1), "]}")
    brave = text('{"web":{"results":[', item(name, "url", '"description":"d"', 1), ",", item(name, "url", '"description":"e"', 2), "]}}")
    html = text('<div class="results"><div class="result"><a class="result__a" href="https://r.example.com/', k, '">', name, ' &amp; x</a><a class="result__snippet">an <b>s</b></a></div>',
                '<div class="result"><a class="result__a" href="https://r.example.com/', k, '">again</a></div></div>')
    docs = table(spark, sf_dir, "supplier")
    answer = lambda body: docs.select(k.alias("query_id"), body.alias("body"))
    out = search_results.serpapi(answer(serp)).unionByName(search_results.exa(answer(exa)))
    return out.unionByName(search_results.brave(answer(brave), most=1)).unionByName(search_results.duckduckgo(answer(html)))


def wire_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary answers packed from suppliers and read back."""
    k = F.col("s_suppkey")
    label = text("v", k)
    size = lambda c, more: F.lpad(F.hex(F.octet_length(c) + more), 2, "0")
    dns = F.concat(F.lit("000181800001000100000000" + "0776657273696F6E0462696E640000100003" + "C00C00100003000000000" + "0"), size(label, 1), size(label, 0), F.hex(label.cast("binary")))
    inner = F.concat(F.lit("06032B0601"), F.lit("04"), size(label, 0), F.hex(label.cast("binary")))
    bind = F.concat(F.lit("30"), F.lpad(F.hex(F.octet_length(label) + 7), 2, "0"), inner)
    pdu = F.concat(F.lit("020101020100020100"), F.lit("30"), F.lpad(F.hex(F.octet_length(label) + 9), 2, "0"), bind)
    snmp = F.concat(F.lit("30"), F.lpad(F.hex(F.octet_length(label) + 33), 2, "0"), F.lit("020100" + "04067075626C6963" + "A2"), F.lpad(F.hex(F.octet_length(label) + 20), 2, "0"), pdu)
    mysql = F.concat(F.lit("4A0000000A"), F.hex(text("8.0.", k).cast("binary")), F.lit("00FF"))
    rows = table(spark, sf_dir, "supplier").select(k, F.unhex(dns).alias("dns"), F.unhex(snmp).alias("snmp"), F.unhex(mysql).alias("mysql"))
    return rows.select(
        "s_suppkey",
        wire.apply(wire.dns_txt, F.col("dns")).alias("dns"),
        wire.apply(wire.snmp_text, F.col("snmp")).alias("snmp"),
        wire.apply(wire.banner_service, F.col("mysql")).alias("banner"),
        wire.apply(wire.decoded_banner, F.unhex(F.lit("E9"))).alias("latin"),
    )


QUERIES = {
    f.__name__: f
    for f in (stream_window_counts, stream_rate_limit, stream_cache, stream_new_items, label_evaluation, content_model_training, search_services, wire_answers)
}

_DIVIDE = "CASE WHEN {1} > 0 THEN round(({0})::DOUBLE / ({1}), 6) ELSE 0.0 END"
SQL = {
    "stream_window_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_rate_limit": f"SELECT key::VARCHAR AS key, n_requests, n_waited, total_wait FROM ({policy_queries.SQL['token_bucket']})",
    "stream_cache": """WITH RECURSIVE e AS (
    SELECT user_id || '/' || event_type AS key, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS n FROM events
), f AS (
    SELECT key, n, t + 3600.0 AS until, 0 AS hits FROM e WHERE n = 1 UNION ALL
    SELECT f.key, e.n, CASE WHEN e.t < until THEN until ELSE e.t + 3600.0 END, hits + (e.t < until)::INT
    FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1
) SELECT key, max(n) AS n_requests, max(hits)::BIGINT AS n_hits FROM f GROUP BY key""",
    "stream_new_items": "SELECT count(*) AS n, count(*) AS guids FROM (SELECT DISTINCT user_id, event_type FROM events)",
    "label_evaluation": f"""SELECT *, {_DIVIDE.format("tp", "tp + fp")} AS precision, {_DIVIDE.format("tp", "tp + fn")} AS recall,
    {_DIVIDE.format("2 * tp", "2 * tp + fp + fn")} AS f1, {_DIVIDE.format("tp + tn", "tp + fp + fn + tn")} AS accuracy FROM (
    SELECT lang, count(*) FILTER (WHERE quality = 1 AND n_chars >= 1000) AS tp, count(*) FILTER (WHERE quality <> 1 AND n_chars >= 1000) AS fp,
        count(*) FILTER (WHERE quality = 1 AND n_chars < 1000) AS fn, count(*) FILTER (WHERE quality <> 1 AND n_chars < 1000) AS tn
    FROM labels JOIN documents USING (doc_id) GROUP BY lang)""",
    # Articles, their headings and paragraphs on the one hand, menus, their lists and footers on the other.
    "content_model_training": r"""SELECT sum(2 + len(regexp_extract_all(regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1), '<p>')))::BIGINT AS tp,
    0::BIGINT AS fp, 0::BIGINT AS fn, 3 * count(*) AS tn FROM pages""",
    "search_services": """SELECT s_suppkey AS query_id, p AS position, title, url, snippet, source FROM (
    SELECT s_suppkey, 0 AS p, 'box' AS title, 'https://b.example.com/' AS url, s_suppkey::VARCHAR AS snippet, 'serpapi' AS source FROM supplier
    UNION ALL SELECT s_suppkey, 1, s_name, 'https://r.example.com/' || s_suppkey || '/1', 's', 'serpapi' FROM supplier
    UNION ALL SELECT s_suppkey, 7, s_name, 'https://r.example.com/' || s_suppkey || '/2', 't', 'serpapi' FROM supplier
    UNION ALL SELECT s_suppkey, 1, s_name, 'https://r.example.com/' || s_suppkey || '/1', 'h', 'exa' FROM supplier
    UNION ALL SELECT s_suppkey, 1, s_name, 'https://r.example.com/' || s_suppkey || '/1', 'd', 'brave' FROM supplier
    UNION ALL SELECT s_suppkey, 1, s_name || ' & x', 'https://r.example.com/' || s_suppkey, 'an s', 'duckduckgo' FROM supplier)""",
    "wire_answers": "SELECT s_suppkey, 'v' || s_suppkey AS dns, 'v' || s_suppkey AS snmp, 'mysql 8.0.' || s_suppkey AS banner, 'é' AS latin FROM supplier",
}
