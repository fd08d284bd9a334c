"""Rows that stand very often, as portions of bounded weight.

A hash of its columns puts all copies of a row into one place. Copies that together weigh
more than a bound are therefore counted, which needs no row to move, and split into
portions that hash to places of their own. Copies are interchangeable, so portions of
the same sizes give the same result in every run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.runtime import checkpointed, written


@dataclass(frozen=True)
class Split:
    """``sums``: key, copies and weight of each key, a hash of the columns; ``rare``: key and row, a
    struct, for the rows of light keys; ``portions``: key, row, part, copies for each portion of the others."""

    sums: DataFrame
    rare: DataFrame
    portions: DataFrame


def split_copies(rows: DataFrame, weight: Column, most: int) -> Split:
    """rows whose copies weigh ``most`` at most as they are, all others in portions of ``most`` or of one copy.

    ``weight`` is that of one row. At most (weight of all rows / most) keys are heavy;
    their table is written, so Spark knows its size when it plans the joins.
    """
    row = F.struct(*rows.columns)
    keyed = rows.select(F.xxhash64(*rows.columns).alias("key"), weight.cast("long").alias("weight"), row.alias("row"))
    sums = checkpointed(keyed.groupBy("key").agg(F.count("*").alias("copies"), F.sum("weight").alias("weight")))
    heavy = written(sums.filter(F.col("weight") > most).select("key"))
    one = F.greatest(F.floor(F.lit(most) / F.col("weight")), F.lit(1))
    last = F.floor((F.col("total") - 1) / F.col("one"))
    portions = (
        keyed.join(heavy, "key", "left_semi")
        .groupBy("key", "row", "weight")
        .agg(F.count("*").alias("total"))
        .withColumn("one", one)
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .withColumn("copies", F.least("one", F.col("total") - F.col("part") * F.col("one")))
        .select("key", "row", "part", "copies")
    )
    return Split(sums, keyed.join(heavy, "key", "left_anti").select("key", "row"), written(portions))
