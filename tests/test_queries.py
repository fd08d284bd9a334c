"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from webloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return "NULL"
        return repr(round(float(v), 6)) if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    found, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_learned_core_is_the_article(spark):
    found = {r.tag: r.n for r in QUERIES["learned_core"](spark, "/root/testdata/sf0.01").collect()}
    assert found == {"article": 250}


def test_folds_and_streams_agree(spark):
    fold = {r.key: (r.n_requests, r.n_waited) for r in QUERIES["token_bucket"](spark, SF).collect()}
    stream = {int(r.key): (r.n_requests, r.n_waited) for r in QUERIES["stream_rate_limit"](spark, SF).collect()}
    assert fold == stream


def test_all_urls_of_larger_tables_are_discovered(spark, duck):
    sf = "/root/testdata/sf0.01"
    want = duck.execute(SQL["discover_all_urls"].replace("FROM part", f"FROM '{sf}/part.parquet'")).df()
    found = QUERIES["discover_all_urls"](spark, sf).toPandas()
    assert rows(found) == rows(want) and found["source"].value_counts().to_dict() == {"sitemap": 1800, "page_link": 1800}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
