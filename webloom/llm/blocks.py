"""Pairs within cells of any size, in blocks of bounded size.

A cell's rows are dealt by hash to chunks, and each pair of chunks is a block, a group
of its own. So a hot cell is split among many tasks, no task holds more than two
chunks, and pairs never leave a block: it returns counts and the edges of a forest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F


def in_blocks(rows: DataFrame, keys: list[str], spread: str, chunk: int) -> GroupedData:
    """rows grouped by keys, lo and hi; ``own`` is the chunk of a row, lo or hi."""
    chunks = rows.groupBy(*keys).agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    dealt = rows.join(chunks, keys).withColumn("own", F.pmod(F.xxhash64(spread), F.col("chunks")))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    return (
        paired.withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
        .drop("other", "chunks")
        .groupBy(*keys, "lo", "hi")
    )


class Forest:
    """Components of the nodes 0 to n - 1 of a block."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def link(self, node: int, others: np.ndarray) -> None:
        own, found = self.label[node], self.label[others]
        if (found == own).all():
            return
        joined = np.unique(np.append(found, own))
        self.label[np.isin(self.label, joined[1:])] = joined[0]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """An edge for each node that isn't the first of its component."""
        nodes = np.flatnonzero(self.label != np.arange(len(self.label)))
        return nodes, self.label[nodes]
