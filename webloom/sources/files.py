"""Recorded files as tables: HTML pages and sitemaps, packed or not, as they stand in a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.sources.bodies import decoded
from webloom.sources.feeds import sitemap_tree


def recorded_files(spark: SparkSession, path: str, pattern: str = "*", most: int = 50 << 20) -> DataFrame:
    """url (the file's place), length, packed (its bytes), error of the files below path whose names fit a pattern.

    A file of more than ``most`` bytes has the error ``too large`` and no bytes: the bound is a filter of the scan, so such a
    file isn't opened. Files are dealt to tasks by Spark, from any store that it reads.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    null = F.lit(None)
    small = files.filter(F.col("length") <= most).select(F.col("path").alias("url"), "length", F.col("content").alias("packed"), null.cast("string").alias("error"))
    large = files.filter(F.col("length") > most).select(F.col("path").alias("url"), "length", null.cast("binary").alias("packed"), F.lit("too large").alias("error"))
    return small.unionByName(large)


def html_files(spark: SparkSession, path: str, pattern: str = "*.html", most: int = 50 << 20) -> DataFrame:
    """page_id (a hash of the place), url, charset, html, error of recorded pages; charsets are told as for bodies without a header."""
    files = recorded_files(spark, path, pattern, most).withColumn("body", F.col("packed")).withColumn("content_type", F.lit(None).cast("string"))
    told = decoded(files)
    return told.select(F.xxhash64("url").alias("page_id"), "url", "charset", "html", "error")


def sitemap_files(spark: SparkSession, path: str, pattern: str = "*", most: int = 50 << 20, max_depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Entries and visits, as of ``feeds.sitemap_tree``, of all recorded sitemaps below path, packed or not; each file is a start."""
    files = recorded_files(spark, path, pattern, most)
    entries, visits = sitemap_tree(files.filter("error IS NULL").select("url", "packed"), files.filter("error IS NULL").select("url"), max_depth, most)
    large = files.filter("error IS NOT NULL").select("url", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), "error", F.lit(None).cast("long").alias("n"))
    return entries, visits.unionByName(large)
