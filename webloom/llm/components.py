"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.runtime import checkpointed


def _large_star(stars: DataFrame) -> DataFrame:
    """Of every node, the others above it move to the least of the node and its others."""
    pairs = stars.unionByName(stars.select(F.col("other").alias("node"), F.col("node").alias("other")))
    least = pairs.groupBy("node").agg(F.least("node", F.min("other")).alias("least"))
    moved = pairs.filter("other > node").join(least, "node")
    return moved.select(F.col("other").alias("node"), F.col("least").alias("other")).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    """Every node and the others below it move to the least of those."""
    least = stars.groupBy("node").agg(F.min("other").alias("least"))
    moved = stars.join(least, "node").select(F.col("other").alias("node"), F.col("least").alias("other"))
    own = least.select("node", F.col("least").alias("other"))
    return moved.filter("node <> other").unionByName(own).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b) that isn't the least of its component.

    ``component`` is the least node reachable. Edges contract until each node points
    at that; a round only groups, joins and deduplicates, so a hub of any size is dealt
    out like other rows. Self loops, repeated edges and null ends are ignored. Each
    round is written to the shared checkpoint folder, which cuts the lineage.
    """
    directed = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    stars, seen = checkpointed(directed.filter(F.col("a") != F.col("b")).distinct()), None
    while True:
        digest = F.sum(F.xxhash64("node", "other").cast("decimal(20,0)"))
        mark = tuple(stars.agg(F.count("*"), digest).first())
        if mark == seen or not mark[0]:
            return stars.select("node", F.col("other").alias("component"))
        stars, seen = checkpointed(_small_star(_large_star(stars))), mark


def least_reachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root, component): for each of (node, least) its component's least node and smallest ``least``.

    Nodes are linked by edges (a, b); a node without one is its own root.
    """
    found = connected_components(edges)
    rooted = nodes.join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return rooted.join(least, "root").select("node", "root", "component")
