"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One recorded table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The parts of a URL in DuckDB, by the number of their group.
URL_PATTERN = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"


def part(column: str, group: int) -> str:
    """SQL for one part of a URL."""
    return f"regexp_extract({column}, '{URL_PATTERN}', {group})"


def host(column: str) -> str:
    """SQL for the lower-case host without www."""
    return f"regexp_replace(lower({part(column, 4)}), '^www\\.', '')"
