"""Sitemap trees with their errors, WHOIS dates, and feeds polled as a stream."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from webloom.operators import domain_intel
from webloom.sources import feeds
from webloom.streaming import polls

#: Dates as registries write them, and what is read.
DATES = {
    "2020-01-02T03:04:05Z": "2020-01-02T03:04:05", "2020-01-02T03:04:05+0200": "2020-01-02T03:04:05+02:00", "2020-01-02T03:04:05-05:30": "2020-01-02T03:04:05-05:30", "2020-01-02 03:04:05": "2020-01-02T03:04:05",
    "2020-01-02": "2020-01-02T00:00:00", "02-Jan-2020": "2020-01-02T00:00:00", "02-Jan-2020 03:04:05 UTC": "2020-01-02T03:04:05", "2020/01/02": "2020-01-02T00:00:00", "02/01/2020": "2020-01-02T00:00:00",
    "2020.01.02": "2020-01-02T00:00:00", "02.01.2020": "2020-01-02T00:00:00", "20200102": "2020-01-02T00:00:00", "January 2, 2020": "2020-01-02T00:00:00", "2 January 2020": "2020-01-02T00:00:00",
    "02-Jan-2020 03:04:05": "2020-01-02T03:04:05", "Thu Jan 02 03:04:05 UTC 2020": "2020-01-02T03:04:05", "Thu Jan 2 03:04:05 GMT 2020": "2020-01-02T03:04:05", "2020-01-02T03:04:05.123Z": "2020-01-02T03:04:05.123000",
    "2020-01-02T03:04:05.000Z": "2020-01-02T03:04:05", "2020-01-02 03:04:05 UTC": "2020-01-02T03:04:05", "2020-01-02 03:04:05+0200": "2020-01-02T03:04:05+02:00", "2020-01-02 03:04:05Z": "2020-01-02T03:04:05+00:00",
    "2020-01-02 03:04:05 (+0900)": "2020-01-02T03:04:05+09:00", "before 2020-01-02": "2020-01-02T00:00:00", " Before  2020/01/02. ": "2020-01-02T00:00:00", "2020-13-02": None, "soon": None, "": None,
    "02-Jan-2020.": "2020-01-02T00:00:00", "2020-02-30": None, "31/02/2020": None,
}


def test_whois_dates_of_every_format(spark):
    found = {r.t: r.d for r in spark.createDataFrame([(d,) for d in DATES], "t string").withColumn("d", domain_intel.whois_date(F.col("t"))).collect()}
    assert found == DATES


def index(*names):
    return f"<sitemapindex>{''.join(f'<sitemap><loc>{n}</loc></sitemap>' for n in names)}</sitemapindex>".encode()


def urlset(*names):
    return f"<?xml version='1.0'?><urlset>{''.join(f'<url><loc>{n}</loc></url>' for n in names)}</urlset>".encode()


def test_sitemap_trees_tell_their_errors(spark):
    files = {
        "root": index("a", "b.gz", "root", "gone", "broken.gz", "bomb.gz", "large", "blank", "d1", "a"), "a": urlset("u1", "u2"), "b.gz": gzip.compress(index("a", "text")), "text": b"https://u3\nno\nhttps://u4\n",
        "broken.gz": b"\x1f\x8bnothing", "bomb.gz": gzip.compress(b"x" * 5000), "large": b"<urlset>" + b" " * 3000, "blank": b" \n", "d1": index("d2"), "d2": index("d3", "e3"), "d3": index("d4"), "d4": urlset("u5"), "e3": urlset(), "other": urlset("u6"),
    }
    rows = [(u, b) for u, b in files.items()] + [("a", files["a"]), (None, b"x")]
    start = spark.createDataFrame([("root",), ("none",)], "url string")
    entries, visits = feeds.sitemap_tree(spark.createDataFrame(rows, "url string, packed binary"), start, 3, 2000)
    assert sorted((r.url, r.depth, r["loc"]) for r in entries.collect()) == [("a", 1, "u1"), ("a", 1, "u2"), ("text", 2, "https://u3"), ("text", 2, "https://u4")]
    found = sorted((r.url, r.parent or "", r.depth, r.error or "", r.n if r.n is not None else -1) for r in visits.collect())
    assert found == sorted([
        ("root", "", 0, "", 10), ("none", "", 0, "missing", -1), ("a", "root", 1, "", 2), ("a", "root", 1, "again", -1), ("b.gz", "root", 1, "", 2), ("root", "root", 1, "again", -1), ("gone", "root", 1, "missing", -1),
        ("broken.gz", "root", 1, "broken", -1), ("bomb.gz", "root", 1, "too large", -1), ("large", "root", 1, "too large", -1), ("blank", "root", 1, "empty", -1), ("d1", "root", 1, "", 1), ("a", "b.gz", 2, "again", -1),
        ("text", "b.gz", 2, "", 2), ("d2", "d1", 2, "", 2), ("d3", "d2", 3, "", 1), ("e3", "d2", 3, "", 0), ("d4", "d3", 4, "too deep", -1),
    ])
    entries, visits = feeds.sitemap_tree(spark.createDataFrame([], "url string, packed binary"), start.filter("false"))
    assert entries.count() == 0 and visits.count() == 0


def rss(*items):
    return "<rss><channel>" + "".join(f"<item><title>t{g}</title><guid>{g}</guid><pubDate>{day} Mar 2024 10:00:00 GMT</pubDate></item>" for g, day in items) + "</channel></rss>"


def test_polls_pass_items_on_once(spark, tmp_path):
    folder, base = str(tmp_path / "in"), str(tmp_path / "out")
    told = []
    for n, bodies in enumerate([
        [(1, rss(("a", 1), ("b", 2))), (2, rss(("c", 2), ("a", 1)))],
        [(1, rss(("a", 1), ("b", 2), ("d", 20))), (3, "no feed"), (4, None), (5, "<rss><channel><item><title>x</title></item></channel></rss>")],
        [(1, rss(("d", 20), ("e", 21), ("late", 3)))],
        [(1, rss(("e", 21), ("f", 28)))],
    ]):
        spark.createDataFrame(bodies, polls.BODIES).write.mode("append").parquet(folder)
        told.append(polls.poll(spark, folder, base))
        rows = [(r.guid, r.published.day) for r in polls.polled(spark, base).collect()]
        assert len(rows) == len(set(rows))
        assert {g for g, _ in rows} == [{"a", "b", "c"}, {"a", "b", "c", "d"}, {"a", "b", "c", "d", "e"}, {"a", "b", "c", "d", "e", "f"}][n]
    assert sum(x["late"] for x in told[2]) == 1 and sum(x["forgotten"] for poll in told for x in poll) >= 3
    assert told[-1][-1]["kept"] < 6 and polls.poll(spark, folder, base) is not None
    assert polls.polled(spark, base).count() == 6


@pytest.mark.parametrize("text", ["2020-01-02T03:04:05.1234567Z", "Thu Jan 02 03:04:05 CET 2020"])
def test_other_dates_are_null(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(domain_intel.whois_date(F.col("t"))).first()[0] is None
