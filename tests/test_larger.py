"""What shows only on larger or rarer inputs."""

from __future__ import annotations

import os

import duckdb
from pyspark.sql import functions as F

from webloom.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def test_a_sitemap_is_not_looked_at_again_for_each_of_its_entries(spark):
    from webloom.sources import feeds

    files = spark.range(1).select(F.lit("https://s.example.com/").alias("url"), F.lit("<urlset><url><loc>https://a/</loc></url></urlset>").alias("body"))
    files = files.withColumn("body", F.concat("body", F.uuid()))
    plan = feeds.sitemap_entries(files)._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Generate explode")
    assert below and "sitemapindex" not in above and "sitemapindex" in below


def test_customers_of_any_number_fit_their_sitemap(spark, tmp_path):
    os.symlink(f"{SF}/nation.parquet", tmp_path / "nation.parquet")
    duck = duckdb.connect()
    duck.execute(f"COPY (SELECT i AS c_custkey, 'x' AS c_name, (i % 40000 // 39999)::INTEGER AS c_nationkey, 0.0::DOUBLE AS c_acctbal, 'y' AS c_mktsegment FROM range(100000, 140000) r(i)) TO '{tmp_path}/customer.parquet'")
    for name in ("nation", "customer"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    found = QUERIES["sitemap_sources"](spark, str(tmp_path)).select("url", "depth", "error", "n").collect()
    want = duck.execute(f"SELECT url, depth, error, n FROM ({SQL['sitemap_sources']})").fetchall()
    assert sorted(map(tuple, found)) == sorted(want)


def test_rows_made_by_parsing_are_not_broadcast(spark, tmp_path):
    def joins(df):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        return plan.count("BroadcastHashJoin"), plan.count("SortMergeJoin")

    for name in ("heuristic_breadth", "readability_siblings", "path_labels"):
        broadcast, merged = joins(QUERIES[name](spark, SF))
        assert not broadcast and merged, name


def test_words_end_with_their_block_and_go_on_across_inline_tags():
    from webloom.sources.dom import parse

    words = {row["tag"]: row["words"] for row in parse("<article><h1>one</h1><p>two<br>three f<b>ou</b>r</p>five<ul><li>six<li>seven</ul></article>")}
    assert words["article"] == 7 and words["p"] == 3 and words["ul"] == 2


def test_parsers_hold_the_rows_of_few_pages():
    import pyarrow as pa

    from webloom.runtime import portions

    batch = pa.RecordBatch.from_arrays([pa.array(range(200))], ["x"])
    found = list(portions(iter([batch, batch.slice(0, 0)])))
    assert [b.num_rows for b in found] == [64, 64, 64, 8] and sum((b.column(0).to_pylist() for b in found), []) == list(range(200))


def test_metadata_is_told_where_a_page_is_parsed(spark):
    for name in ("meta_precedence", "meta_opengraph", "org_entity"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Aggregate" not in plan and "SortMergeJoin" not in plan, name


def test_small_joined_inputs_are_spread(spark):
    from webloom.runtime import spread
    from webloom.sources import rendered

    assert "Repartition" in spread(rendered.og_pages(spark, "/root/testdata/sf0.1"))._jdf.queryExecution().logical().toString()


def test_breadths_share_one_parse(spark, monkeypatch):
    from webloom.operators import readability

    def again(*_):
        raise AssertionError("parsed again")

    monkeypatch.setattr(readability, "nodes", again)
    assert QUERIES["content_scope"](spark, SF).count() > 0


def test_cells_are_told_where_a_page_is_parsed(spark):
    from webloom.sources import blocks, rendered

    plan = blocks.cells(rendered.table_pages(spark, SF))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Window" not in plan.partition("MapInArrow")[0] and "Sort" not in plan and "doc#" not in plan


def test_columns_are_counted_before_they_are_sorted(spark):
    plan = QUERIES["table_column_types"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    above, _, below = plan.partition("SortAggregate")
    assert "Window" not in plan and "HashAggregate" in below and plan.count("MapInArrow") == 1


def test_places_of_cells_in_odd_tables():
    from webloom.sources.dom import page_cells, parse

    source = "<td>stray<table><td>a<td colspan=2>b<thead><tr><td>c</thead><tr><td colspan='3\n'>d<table><tr><th>e</table>f<td colspan=99999999999>g</table>"
    assert page_cells(source) == [
        [0, 0, 0, False, 1, "a"], [0, 0, 1, False, 2, "b"], [0, 0, 3, True, 1, "c"], [0, 1, 0, False, 3, "df"], [1, 0, 0, True, 1, "e"], [0, 1, 3, False, 1, "g"],
    ]
    counted, plain = [], []
    parse(source, counted)
    parse(source, plain, counted=False)
    fields = ("nid", "tag", "attrs", "skipped")
    assert [(k, v if k == "text" else [v[f] for f in fields]) for k, v in counted] == [(k, v if k == "text" else [v[f] for f in fields]) for k, v in plain]


def test_mail_records_are_sorted_behind_their_shuffle(spark):
    for name in ("mail_posture", "domain_profile"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_COL" in plan and all("SortAggregate" not in part for part in plan.split("REPARTITION_BY_COL")[1:]), name


def test_the_least_of_several_policies_counts(spark):
    from webloom.operators import domain_intel

    rows = [("d", "TXT", "d", '"v=spf1 ~all"'), ("d", "TXT", "d", "v=spf1 +all"), ("d", "TXT", "_dmarc.d", "v=DMARC1; p=reject"), ("d", "TXT", "_dmarc.d", "v=DMARC1; p=none"),
            ("d", "TXT", "k1._domainkey.d", "p=x"), ("e", "A", "e", "192.0.2.1"), ("f", "TXT", "f", None)]
    found = domain_intel.mail_security(spark.createDataFrame(rows, "domain string, record_type string, name string, value string")).collect()
    assert sorted(map(tuple, found)) == [("d", "weak", "configured", "weak", "moderate"), ("e", "missing", "missing", "missing", "missing"), ("f", "missing", "missing", "missing", "missing")]


def test_cached_keys_share_calls_and_keep_their_entries_across_batches(spark, tmp_path):
    from webloom.streaming import stateful

    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000 + s))
    for part, times in (("a", (0, 50, 100)), ("b", (120, 150, 300))):
        keys = spark.range(300).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(100.0).alias("ttl"))
        rows = [keys.select("key", at(s).alias("ts"), "ttl") for s in times]
        rows[0].unionByName(rows[1]).unionByName(rows[2]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("key string, ts timestamp, ttl double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stateful.cached(source, late_s=1000, buckets=8)
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).format("parquet").option("path", str(tmp_path / "out")).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 8 and len(query.recentProgress) >= 2
    found = spark.read.parquet(str(tmp_path / "out")).groupBy((F.unix_seconds("ts") - 1_700_000_000).alias("s"), "hit").count().collect()
    assert sorted(map(tuple, found)) == [(0, False, 300), (50, True, 300), (100, False, 300), (120, True, 300), (150, True, 300), (300, False, 300)]
