"""Sinks for extracted documents: text, JSON and partitioned Parquet, and a keyed store that checks what it reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.sources.files import html_files


def write_documents(docs: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write (page_id, url, text, ...) by host; ``text`` keeps the text alone, ``json`` an object a row."""
    rows = docs.withColumn("host", urls.host(F.col("url")))
    if kind == "text":
        rows.select("host", F.col("text").alias("value")).write.partitionBy("host").text(path)
    elif kind in ("json", "parquet"):
        rows.write.partitionBy("host").format(kind).save(path)
    else:
        raise ValueError(f"unknown format {kind!r}")


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """Local or stored HTML files as pages: page_id (a hash of the path), url, html."""
    return html_files(spark, path).select("page_id", "url", "html")


def write_store(entries: DataFrame, path: str) -> None:
    """Write (key, value) with a digest of the value, in folders by the first two digits of the key."""
    entries.select("key", "value", F.sha2("value", 256).alias("digest"), F.substring("key", 1, 2).alias("shard")).write.mode("append").partitionBy("shard").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the entries whose value still has its digest."""
    return spark.read.parquet(path).filter(F.sha2("value", 256) == F.col("digest")).select("key", "value")
