"""What every operator of this subpackage needs from the session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from webloom.runtime import checkpointed, ensure_checkpoint_dir

__all__ = ["checkpointed", "fresh", "read_table", "shared_dir", "written"]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder: computed once, without its lineage, and of a size that Spark knows."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the test data as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, columns: list[str]) -> str:
    """name, with underscores behind it until it is none of columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
