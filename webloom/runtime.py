"""What operators that iterate need from the session."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that a parser gathers before it hands them on.
MOST_ROWS = 4096


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in spark.checkpoint.dir.

    A folder of our own is set only where none is named and driver and executors are one
    machine; anywhere else it would be lost with an executor, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder with its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, bytes_a_task: int = 16 << 20) -> DataFrame:
    """df dealt to all cores if it is small, for work that costs far more than its input's bytes.

    A small file is one task, however long its rows take to parse. Larger inputs are
    split by their scan and stay as they are, so what is shuffled here is bounded.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    # The bytes that are read: for a join Spark multiplies the sizes of its sides, which is no measure of them.
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(cores) if size < cores * bytes_a_task else df


def grown(df: DataFrame) -> DataFrame:
    """df as a side of joins that sort and merge: for rows made by parsing or exploding.

    Spark guesses their size from the input's bytes, far too low, and would collect them to the driver for a broadcast.
    """
    return df.hint("merge")


def portions(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Slices of batches: what is made of their rows in Python is held for a few of them, not for 10,000."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
