"""Running a streaming query to its end over recorded files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from webloom.runtime import ensure_checkpoint_dir


def recorded_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A recorded table as a stream of files; its local times are taken for event times."""
    path = f"{sf_dir}/{name}.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("recursiveFileLookup", "true").parquet(path)
    return rows.withColumns({c: rows[c].cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows that a stream gives when all its input was read, from the shared folder.

    In append mode they are written by the file sink; in complete mode each batch
    replaces the rows before it, and the last one stays.
    """
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state")
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/rows").start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
