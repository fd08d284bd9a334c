"""Two-pass external shuffle into shards, with DataFrame expressions only.

Pass one scatters the records uniformly into memory-sized buckets by a seeded hash; a
record that stands so often that its copies would overfill a bucket is scattered in portions.
Pass two puts each bucket into a defined order and shuffles it with Spark's
Fisher-Yates ``shuffle``. The buckets one after another are a random order of all
records, which is cut into shards whose row counts differ by one at most.

A lost executor changes nothing: a bucket is a partition of its own and is sorted before
it is shuffled, and the generator starts from the seed and the partition, so a task that
runs again gives the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.copies import split_copies
from webloom.llm.runtime import written

BUCKET_BYTES = 32 << 20
#: Share of a bucket from which the copies of one record go in portions.
PORTION = 1 / 8


def shard_records(docs: DataFrame, n_shards: int = 8, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, text, shard, slot: every record in its place.

    ``slot`` counts from 0 without gaps inside a shard. The first shards get one row
    more where the rows don't divide evenly. A null text stays null and weighs one
    byte, a null doc_id hashes as null. Rows that are equal in both columns are
    interchangeable; equal texts under different ids are not kept together. An empty
    table gives no rows. Other columns of the input are ignored. ``bucket_bytes`` bounds
    what one task holds, apart from single records that are larger; a bucket is a
    partition, so it should grow with tables of very many.
    """
    records = docs.select("doc_id", "text")
    weight = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    split = split_copies(records, weight, max(int(bucket_bytes * PORTION), 1))
    n_bytes = split.sums.agg(F.sum("weight")).first()[0] or 0
    n_buckets = max(1, math.ceil(n_bytes / bucket_bytes))

    def bucket(part: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "key", part), F.lit(n_buckets)).cast("int").alias("bucket")

    none, heavy = F.lit(0).cast("long"), split.portions.select("key").distinct()
    light = split.sums.join(heavy, "key", "left_anti").select(bucket(none), "copies")
    scattered = split.rare.select(bucket(none), "row.*", F.lit(1).cast("long").alias("copies"))
    portions = split.portions.select(bucket(F.col("part")), "row.*", "copies")

    # One row a bucket: its place in the order of all records. Written, so that its size decides how it is joined.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    places = (
        light.unionByName(portions.select("bucket", "copies"))
        .groupBy("bucket")
        .agg(F.sum("copies").alias("rows"))
        .select(
            "bucket",
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"),
            F.sum("rows").over(every).alias("total"),
        )
    )
    places = written(places)
    record = F.struct("doc_id", "text", "copies")
    each = F.transform("records", lambda r: F.array_repeat(F.struct(r["doc_id"], r["text"]), r["copies"].cast("int")))
    shuffled = (
        scattered.unionByName(portions)
        .repartitionById(n_buckets, F.col("bucket"))
        .groupBy("bucket")
        .agg(F.array_sort(F.collect_list(record)).alias("records"))
        .select("bucket", F.shuffle(F.flatten(each), F.lit(seed)).alias("records"))
    )
    placed = (
        shuffled.join(places, "bucket")
        .select("first", "total", F.posexplode("records").alias("at", "record"))
        .select("record.*", (F.col("first") + F.col("at")).alias("place"), "total")
    )
    # The first `extra` shards have size + 1 rows, the others size.
    size, extra = F.floor(F.col("total") / n_shards), F.col("total") % n_shards
    edge = extra * (size + 1)
    shard = F.when(F.col("place") < edge, F.floor(F.col("place") / (size + 1))).otherwise(
        extra + F.floor((F.col("place") - edge) / F.greatest(size, F.lit(1)))
    )
    first = F.col("shard") * size + F.least(F.col("shard"), extra)
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id", "text", "shard", (F.col("place") - first).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, seed: int = 42) -> None:
    """Write the shards as Parquet, a folder for each, rows in the order of their slots."""
    (
        shard_records(docs, n_shards, seed)
        .repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
