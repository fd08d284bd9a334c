"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources in code point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share the
words of all documents. A target stops at three times its source's words; what is
over is shared again by weight until no target is above. The words are handed out as
blocks of equal size: a source gets as many blocks as the highest quotients of its
target give it; groups of its shards, then the shards of a group, divide its blocks the
same way, by their words. Inside a shard the documents stand in a seeded order; whole
passes take every word, and the rest of the quota are consecutive blocks from a seeded
one on, around the end, so that few documents are cut.

The driver sees one row a source. A shard holds about SHARD_ROWS rows however large its
source is; equal rows count as one unit with copies, of SHARD_ROWS at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.copies import split_copies
from webloom.llm.runtime import checkpointed, written

MOST = 3
WEIGHTS = (1, 2, 3)
BLOCK_WORDS = 16
#: Rows that a shard aims at, and groups of a source's shards at most.
SHARD_ROWS, GROUPS = 4096, 256
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; 0 if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share_targets(sizes: list[int], weights: list[float]) -> list[float]:
    """Shares of sum(sizes) by weight, none above MOST times its size."""
    total, open_, target = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        left = total - sum(target[i] for i in range(len(sizes)) if i not in open_)
        weight = sum(weights[i] for i in open_)
        for i in open_:
            target[i] = left * weights[i] / weight
        over = {i for i in open_ if target[i] > MOST * sizes[i]}
        for i in over:
            target[i] = float(MOST * sizes[i])
        if not over:
            break
        open_ -= over
    return target


def sainte_lague(weights: np.ndarray, most: np.ndarray, blocks: int) -> np.ndarray:
    """Blocks for each weight by the highest quotients w / 1, w / 3, w / 5, ..., none over its most.

    The divisor of the last quotient that wins is found by bisection; what rounding
    leaves goes by the next quotients, ties to the first.
    """
    w, most = np.asarray(weights, float), np.asarray(most, np.int64)
    blocks = int(min(blocks, most[w > 0].sum()))
    if blocks <= 0:
        return np.zeros(len(w), np.int64)
    given = lambda d: np.minimum(np.floor(w / d + 0.5), most).astype(np.int64)
    low, high = w[w > 0].min() / (2.0 * blocks + 3) / 4, 2.0 * w.max() + 1
    while given(low).sum() < blocks:
        low /= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if given(middle).sum() >= blocks else (low, middle)
    out = given(high)
    while (rest := blocks - int(out.sum())) > 0:
        quotient = np.where(out < most, w / (2 * out + 1), -1.0)
        for i in np.argsort(-quotient, kind="stable")[:rest]:
            out[i] += quotient[i] > 0
    return out


def _sources(units: DataFrame, block: int) -> DataFrame:
    """A row a source with its number, groups, shards a group, words, target and quota of blocks."""
    totals = units.groupBy("source").agg(F.sum("copies").alias("rows"), F.sum(F.col("copies") * F.col("size")).alias("words"))
    found = {r.source: r for r in totals.collect()}
    names = sorted(n for n in found if n is not None) + [None] * (None in found)
    sizes = [found[n].words for n in names]
    targets = share_targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(names))])
    most = [-(-MOST * size // block) for size in sizes]
    quotas = sainte_lague(np.array(targets), np.array(most), round(sum(targets) / block)) if names else []
    rows = []
    for number, (name, size, target, quota) in enumerate(zip(names, sizes, targets, quotas, strict=True)):
        shards = -(-found[name].rows // SHARD_ROWS)
        groups = min(GROUPS, -(-shards // GROUPS))
        rows.append((name, number, groups, -(-shards // groups), size, target, int(quota)))
    kind = "name string, number long, groups long, shards long, source_size long, target double, quota long"
    return written(units.sparkSession.createDataFrame(rows, kind))


def _apportioned(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (by, ..., words, most) with their part of ``quota``, the blocks of all that are equal in by."""

    def divide(table: pa.Table) -> pa.Table:
        words, most = (table.column(c).to_numpy() for c in ("words", "most"))
        given = sainte_lague(words, most, table.column("quota")[0].as_py())
        return table.set_column(table.schema.get_field_index("quota"), "quota", pa.array(given))

    return rows.groupBy(*by).applyInArrow(divide, rows.schema)


def _quotas(dealt: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """words and quota, in words, of each (number, group, shard). A task sees the shards of a group or the groups of a source."""
    shards = checkpointed(
        dealt.groupBy("number", "group", "shard")
        .agg(F.sum(F.col("copies") * F.col("size")).alias("words"))
        .withColumn("most", F.ceil(MOST * F.col("words") / block))
    )
    groups = shards.groupBy("number", "group").agg(F.sum("words").alias("words"), F.sum("most").alias("most"))
    divided = _apportioned(groups.join(sources.select("number", "quota"), "number"), ["number"])
    each = shards.join(divided.select("number", "group", "quota"), ["number", "group"])
    quota = F.least(F.col("quota") * block, MOST * F.col("words")).alias("quota")
    return written(_apportioned(each, ["number", "group"]).select("number", "group", "shard", "words", quota))


def _taken(units: DataFrame, plan: DataFrame, seed: int, block: int) -> DataFrame:
    """A row for each copy of units, which have shards, with what plan takes of it."""
    keys = ["number", "group", "shard"]
    line = Window.partitionBy(*keys).orderBy("order", "key", "part", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = F.sum(F.col("copies") * F.col("size")).over(line)
    placed = (
        units.withColumn("last", last)
        .join(plan, keys)
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .withColumn("end", F.col("last") - (F.col("copies") - F.col("copy")) * F.col("size"))
        .withColumn("first", F.col("end") - F.col("size"))
    )
    whole = F.when(F.col("words") > 0, F.floor(F.col("quota") / F.col("words"))).otherwise(0).cast("long")
    blocks = F.greatest(F.floor(F.col("words") / block), F.lit(1))
    begin = F.pmod(F.xxhash64(F.lit(seed), "source", "group", "shard"), blocks) * block
    run = F.col("begin") + F.col("rest")

    def overlap(low: Column, high: Column) -> Column:
        return F.greatest(F.least(F.col("end"), high) - F.greatest(F.col("first"), low), F.lit(0))

    straight = overlap(F.col("begin"), F.least(run, F.col("words")))
    around = overlap(F.lit(0), F.greatest(run - F.col("words"), F.lit(0)))
    cut = F.col("straight") + F.col("around")
    full = (F.col("size") > 0) & (cut == F.col("size"))
    cut_from = F.when(full | (F.col("straight") == 0), 0).otherwise(
        F.greatest(F.col("begin") - F.col("first"), F.lit(0))
    )
    return (
        placed.withColumn("whole", whole)
        .withColumn("rest", F.col("quota") - F.col("whole") * F.col("words"))
        .withColumn("begin", begin)
        .withColumn("straight", straight)
        .withColumn("around", around)
        .withColumn("taken", (F.col("whole") * F.col("size") + cut).cast("long"))
        .withColumn("passes", (F.col("whole") + full.cast("long")))
        .withColumn("cut_from", cut_from.cast("long"))
        .withColumn("cut_words", F.when(full, 0).otherwise(cut).cast("long"))
    )


def _dealt(units: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """units with the figures of their source and their shard."""
    order = F.xxhash64(F.lit(seed), "key", "part")
    return (
        units.join(sources.drop("quota"), units["source"].eqNullSafe(sources["name"]))
        .withColumn("order", order)
        .withColumn("group", F.pmod(F.xxhash64("order"), "groups"))
        .withColumn("shard", F.pmod(F.xxhash64("order", F.lit(1)), "shards"))
    )


def _planned(docs: DataFrame, seed: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Units without their texts, dealt to shards; the sources; the plan. Texts are read once."""
    counted = docs.select(
        F.xxhash64(*docs.columns).alias("key"), "doc_id", "source", word_count(F.col("text")).alias("size")
    )
    units = checkpointed(counted.groupBy(*counted.columns).agg(F.count("*").alias("copies")))
    sources = _sources(units, block)
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / SHARD_ROWS)))
    copies = F.least(F.lit(SHARD_ROWS), F.col("copies") - F.col("part") * SHARD_ROWS).cast("long")
    dealt = _dealt(units.withColumn("part", part).withColumn("copies", copies), sources, seed)
    return dealt, sources, _quotas(dealt, sources, block)


def mix_sources(docs: DataFrame, seed: int = 42, block: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, passes, cut_from, cut_words for every row.

    ``taken`` words of a document are in the mix: ``passes`` times the whole text, then
    ``cut_words`` words from word ``cut_from`` (from 0) on. A cut that goes around the
    end of its shard may leave two pieces of one document; the second is the
    ``cut_words - (size - cut_from)`` words from the start. The cut of a document taken
    whole once more is counted in ``passes``.

    A null source is a source of its own; empty and null texts have size 0 and nothing
    is taken; a null doc_id is an id like any other. Documents are ordered by a hash of
    all their columns, so equal rows are interchangeable and reruns agree. An empty table
    gives no rows. Columns can't be maps, which have no hash.
    """
    dealt, _, plan = _planned(docs, seed, block)
    return _taken(dealt, plan, seed, block).select(
        "doc_id", "source", "size", "source_size", "target", "taken", "passes", "cut_from", "cut_words"
    )


def mixed_documents(docs: DataFrame, seed: int = 42, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself: the rows and columns of docs, each row as often as its passes say.

    A cut is a row of its own with the words of the cut, joined by spaces; ``n_chars``,
    if there is one, is the length of the text that is left.
    """
    _, sources, plan = _planned(docs, seed, block)
    split = split_copies(docs, F.lit(1), SHARD_ROWS)
    alone = split.rare.withColumns({"part": F.lit(0).cast("long"), "copies": F.lit(1).cast("long")})
    units = alone.unionByName(split.portions).withColumns(
        {"doc_id": F.col("row.doc_id"), "source": F.col("row.source"), "size": word_count(F.col("row.text"))}
    )
    placed = _taken(_dealt(units, sources, seed), plan, seed, block)
    words = F.regexp_extract_all("row.text", F.lit(f"({WORD})"), F.lit(1))
    over = F.greatest(F.col("cut_from") + F.col("cut_words") - F.col("size"), F.lit(0)).cast("int")
    first = F.slice(words, (F.col("cut_from") + 1).cast("int"), (F.col("cut_words") - over).cast("int"))
    cut = F.array_join(F.concat(first, F.slice(words, F.lit(1), over)), " ")
    empty = F.array().cast("array<string>")
    texts = F.concat(
        F.array_repeat("row.text", F.col("passes").cast("int")),
        F.when(F.col("cut_words") > 0, F.array(cut)).otherwise(empty),
    )
    rows = placed.filter(F.col("taken") > 0).select("row", F.explode(texts).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
