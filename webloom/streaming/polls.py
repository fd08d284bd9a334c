"""Feeds polled as a stream: each poll adds files, each run reads what is new.

A poll's bodies are files of (feed_id, body). They are parsed inside the stream; an item is passed on once,
and its guid is forgotten when the watermark has passed it, so state grows with the items of a week and not with
all that were ever seen. Items that are later than the watermark are dropped, as their guids may be forgotten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.sources.feeds import parse_feeds
from webloom.streaming.stateful import new_items

BODIES = "feed_id long, body string"


def feed_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The items of all feeds that stand or will stand in a folder of Parquet files, as a stream.

    An item without a guid goes by its link; one without a date, or without both, can't be remembered and is left out.
    """
    bodies = spark.readStream.schema(BODIES).parquet(folder)
    items = parse_feeds(bodies).withColumn("key", F.coalesce(F.nullif("guid", F.lit("")), F.nullif("link", F.lit(""))))
    return items.filter("key IS NOT NULL AND published IS NOT NULL").select("feed_id", "item", "title", "link", "guid", "published", "key")


def poll(spark: SparkSession, folder: str, base: str, late: str = "7 days") -> list[dict]:
    """Pass on the new items of the files that no run has read yet, and tell what the state did.

    ``base`` holds the rows and the stream's state; a run that dies goes on where it was. A row for each batch: rows read, rows that came
    too late, guids remembered and forgotten.
    """
    fresh = new_items(feed_stream(spark, folder), "key", "published", late).drop("key")
    query = (
        fresh.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{base}/state")
        .format("parquet").option("path", f"{base}/rows").start()
    )
    query.awaitTermination()
    told = []
    for progress in query.recentProgress:
        for state in progress["stateOperators"]:
            told.append({
                "batch": progress["batchId"], "read": progress["numInputRows"], "late": state["numRowsDroppedByWatermark"],
                "kept": state["numRowsTotal"], "forgotten": state["numRowsRemoved"],
            })
    return told


def polled(spark: SparkSession, base: str) -> DataFrame:
    """All items passed on so far."""
    return spark.read.parquet(f"{base}/rows")
