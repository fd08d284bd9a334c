"""SimHash near-duplicates, found with vantage-point trees.

Fingerprints that differ in three bits at most differ in one bit at most on one of
their 32-bit halves. For each half a vantage-point tree partitions the fingerprints:
a node sends those whose half is within its radius of the vantage point one way, the
others the other way. By the triangle inequality a fingerprint can only match beyond
a boundary if its own distance is within one bit of the radius, so it visits only the
shards that its ball overlaps; each shard compares whole fingerprints, which makes
the pairs exact. A pair of shards is visited from the lower one alone.

The first trees are fitted on a bounded sample and have a bounded number of shards. A
shard that holds too many fingerprints gets a tree of its own, fitted on a bounded sample
of that shard inside a task, and so on, so shards keep their size as the table grows.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from webloom.llm.blocks import Forest
from webloom.llm.components import least_reachable
from webloom.llm.runtime import checkpointed, fresh

SHINGLE, SEED, BITS = 3, 42, 3
#: Fingerprints a shard aims at, the fingerprints that a tree is fitted on at most, vantage points tried for a node.
SHARD, SAMPLE, TRIALS = 4096, 16_384, 16
#: Trees below each other at most, bits of a shard's number for each, and rows of a shard that one task routes.
ROUNDS, ROUND_BITS, PART = 4, 12, 1 << 18
#: Rows that only visit a shard, as a multiple of those that live there, that one block holds; comparisons done in one go.
GUESTS, COMPARED = 4, 1 << 21
#: Share of a node's rows that may have to go both ways; beyond it the two sides cost more pairs than the node.
MOST_BOTH = 0.4
#: Bytes of a text whose words are looked at in one go.
SLICE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
HALF = 0xFFFFFFFF
_COLUMN = np.arange(8) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _words(text: str) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, a slice of it at a time."""
    data, at = text.encode("utf-8", "surrogatepass"), 0
    while at < len(data):
        cut = _SPACE.search(data, at + SLICE)
        end = cut.start() if cut else len(data)
        yield data[at:end].lower().split()
        at = end


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 if it has no word.

    Beside the text itself, what is held is bounded: words and hashes of a slice.
    """
    total, n, digest = np.zeros(2048, np.int64), 0, xxhash.xxh64_intdigest
    held: list[bytes] = []

    def add(grams) -> None:
        nonlocal n, total
        hashes = np.fromiter((digest(b" ".join(g), SEED) for g in grams), np.uint64)
        total += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _COLUMN).ravel(), minlength=2048)
        n += len(hashes)

    for words in _words(text or ""):
        held += words
        if len(held) >= size:
            add(zip(*[held[i:] for i in range(size)], strict=False))
            held = held[len(held) - size + 1 :]
    if not n:
        if not held:
            return 0
        add([held])
    ones = (total.reshape(8, 256) @ _BITS).ravel()
    return sum(1 << i for i in range(64) if 2 * ones[i] > n)


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, fingerprint (a signed long) and long columns named in more, of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py()) for x in batch.column("text")], np.uint64).view(np.int64)
            columns = [batch.column("doc_id"), pa.array(found), *(batch.column(c) for c in more)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fingerprint", *more])

    schema = ", ".join(f"{c} long" for c in ("doc_id", "fingerprint", *more))
    return docs.select(F.col("doc_id").cast("long"), "text", *more).mapInArrow(hashed, schema)


class Tree:
    """A vantage-point tree over unsigned words of one kind; its leaves are numbered shards.

    ``reach`` is how far apart words that must meet can be.
    """

    def __init__(self, words: np.ndarray, shards: int, seed: int, reach: int = 1) -> None:
        self.nodes: list[tuple[int, int, int, int]] = []
        self.shards, self.reach = 0, reach
        self.root = self._grow(words, shards, np.random.default_rng(seed))

    def _grow(self, words: np.ndarray, shards: int, rng: np.random.Generator) -> int:
        """A node's number, or -1 - the number of a shard."""
        best = None
        if shards > 1 and len(words) > 16:
            for point in rng.choice(words, TRIALS):
                apart = np.bitwise_count(words ^ point)
                for radius in {int(np.median(apart)), int(np.median(apart)) - 1}:
                    inside = (apart <= radius).mean()
                    both = ((apart > radius - self.reach) & (apart <= radius + self.reach)).mean()
                    if 0.2 <= inside <= 0.8 and both <= MOST_BOTH:
                        cost = both + abs(inside - 0.5) / 4
                        best = min(best, (cost, int(point), radius)) if best else (cost, int(point), radius)
        if not best:
            self.shards += 1
            return -self.shards
        _, point, radius = best
        inside = np.bitwise_count(words ^ words.dtype.type(point)) <= radius
        at = len(self.nodes)
        self.nodes.append((point, radius, 0, 0))
        near = self._grow(words[inside], (shards + 1) // 2, rng)
        self.nodes[at] = (point, radius, near, self._grow(words[~inside], shards // 2, rng))
        return at

    def visits(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each shard: its number, the rows whose balls overlap it, and which of those live in it."""
        reach = self.reach
        todo = [(self.root, np.arange(len(words)), np.ones(len(words), bool))]
        while todo:
            node, rows, home = todo.pop()
            if node < 0:
                yield -1 - node, rows, home
                continue
            point, radius, near, far = self.nodes[node]
            apart = np.bitwise_count(words[rows] ^ words.dtype.type(point)).astype(np.int64)
            into, out = apart - reach <= radius, apart + reach > radius
            todo.append((near, rows[into], (home & (apart <= radius))[into]))
            todo.append((far, rows[out], (home & (apart > radius))[out]))


def _half(words: np.ndarray, number: int) -> np.ndarray:
    """One 32-bit half of fingerprints."""
    return ((words >> np.uint64(32 * number)) & np.uint64(HALF)).astype(np.uint32)


def _visited(tree: Tree, words: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shard and whether it lives there, for all visits that are needed; home: which rows live below the tree.

    Rows that live in two shards meet in the higher one; guests visit all they overlap.
    """
    found = list(tree.visits(words))
    own = np.full(len(words), -1)
    for shard, rows, lives in found:
        own[rows[lives]] = shard
    shards = np.concatenate([np.full(len(rows), shard) for shard, rows, _ in found])
    rows = np.concatenate([rows for _, rows, _ in found])
    kept = (own[rows] <= shards) | ~home[rows]
    rows, shards = rows[kept], shards[kept]
    return rows, shards, (own[rows] == shards) & home[rows]


ROUTED = "tree long, shard long, home boolean, node long, fingerprint long"


def _routed(prints: DataFrame, trees: list[Tree]) -> DataFrame:
    """(tree, shard, home, node, fingerprint): a row for each shard that a fingerprint lives in or visits."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("fingerprint").to_numpy().view(np.uint64)
            for number, tree in enumerate(trees):
                rows, shards, home = _visited(tree, _half(words, number), np.ones(len(words), bool))
                taken = batch.select(["node", "fingerprint"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), number)), pa.array(shards), pa.array(home), *taken.columns],
                    ["tree", "shard", "home", "node", "fingerprint"],
                )

    return prints.mapInArrow(route, ROUTED)


def _split(routed: DataFrame, large: DataFrame, seed: int, shard: int, sample: int) -> DataFrame:
    """The rows of large shards (tree, shard, rows) in the shards of trees of their own."""

    def fit(table: pa.Table) -> pa.Table:
        words, rows = np.sort(table.column("fingerprint").to_numpy().view(np.uint64)), table.column("rows")[0].as_py()
        shards = min(-(-rows // shard), 1 << ROUND_BITS)
        tree = Tree(_half(words, table.column("tree")[0].as_py()), shards, seed)
        if tree.shards == 1:  # too many equal halves: whole fingerprints can still differ
            tree = Tree(words, shards, seed, BITS)
        fitted = pickle.dumps((tree, tree.reach == BITS))
        return table.slice(0, 1).select(["tree", "shard", "parts"]).append_column("fitted", pa.array([fitted], pa.binary()))

    def route(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([[]] * 5, pa.schema([("tree", pa.int64()), ("shard", pa.int64()), ("home", pa.bool_()), ("node", pa.int64()), ("fingerprint", pa.int64())]))
        tree, whole = pickle.loads(right.column("fitted")[0].as_py())
        words = left.column("fingerprint").to_numpy().view(np.uint64)
        number = left.column("tree")[0].as_py()
        rows, shards, home = _visited(tree, words if whole else _half(words, number), left.column("home").to_numpy())
        taken = left.take(pa.array(rows))
        path = (taken.column("shard").to_numpy() << ROUND_BITS) | shards
        return pa.table(
            [taken.column("tree"), pa.array(path), pa.array(home), taken.column("node"), taken.column("fingerprint")],
            ["tree", "shard", "home", "node", "fingerprint"],
        )

    keys = ["tree", "shard"]
    rows = routed.join(large, keys)
    share = F.least(F.lit(1.0), F.lit(sample) / F.col("rows"))
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "fingerprint"), 33) < share * (1 << 31)
    parts = large.withColumn("parts", F.ceil(F.col("visits") / PART)).select(*keys, "parts")
    fitted = rows.filter(F.col("home") & drawn).join(parts, keys).groupBy(*keys).applyInArrow(
        fit, "tree long, shard long, parts long, fitted binary"
    )
    dealt = rows.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("fingerprint"), F.col("parts")))
    each = fitted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    by = [*keys, "part"]
    return dealt.groupBy(*by).cogroup(each.groupBy(*by)).applyInArrow(route, ROUTED)


def _blocks(held: DataFrame, chunk: int) -> GroupedData:
    """held in blocks (tree, shard, lo, hi) of rows that live in chunk lo and all rows of chunk hi.

    Of two rows that meet one lives in the shard, so visitors aren't paired with each
    other. Those that live there and those that visit are dealt to chunks by hash; a shard
    of usual size has one of each and is one block, whose rows stand in it once.
    """
    keys, zero = ["tree", "shard"], F.lit(0).cast("long")
    lives = F.ceil(F.count_if("home") / chunk).alias("lives")
    visits = F.ceil(F.count_if(~F.col("home")) / (GUESTS * chunk))
    sizes = held.groupBy(*keys).agg(lives, F.greatest(F.ceil(F.count_if("home") / chunk), visits).alias("chunks"), visits.alias("visits"))
    dealt = held.join(sizes.filter("lives > 0"), keys)
    own = F.pmod(F.xxhash64("fingerprint"), F.when(F.col("home"), F.col("lives")).otherwise(F.col("visits")))
    pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    left = F.transform(F.sequence(zero, F.col("chunks") - 1), lambda hi: pair(F.col("own"), hi))
    right = F.transform(F.sequence(zero, F.col("lives") - 1), lambda lo: pair(lo, F.col("own")))
    block = F.explode(F.when(F.col("home"), F.array_union(left, right)).otherwise(right))
    columns = [*keys, "home", "node", "fingerprint", "own"]
    return dealt.withColumn("own", own).select(*columns, block.alias("block")).select(*columns, "block.*").groupBy(*keys, "lo", "hi")


def _match(table: pa.Table) -> pa.Table:
    """The forest of the fingerprints of one block that differ in BITS bits at most."""
    words = table.column("fingerprint").to_numpy().view(np.uint64)
    nodes, home = table.column("node").to_numpy(), table.column("home").to_numpy()
    own, lo, hi = (table.column(c).to_numpy() for c in ("own", "lo", "hi"))
    left, right = np.flatnonzero(home & (own == lo)), np.flatnonzero(own == hi)
    forest, step = Forest(len(words)), max(COMPARED // max(len(right), 1), 1)
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        close = np.bitwise_count(words[rows][:, None] ^ words[right]) <= BITS
        close &= rows[:, None] != right
        for i in np.flatnonzero(close.any(axis=1)):
            forest.link(rows[i], right[close[i]])
    a, b = forest.edges()
    return pa.table({"a": nodes[a], "b": nodes[b]})


def in_shards(prints: DataFrame, seed: int = SEED, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """(tree, shard, home, node, fingerprint): the shards that each fingerprint lives in or visits."""
    n = prints.count()
    share = min(sample / max(n, 1), 1 / 8)
    drawn = F.pmod(F.xxhash64(F.lit(seed), "fingerprint"), F.lit(1 << 30)) < int(share * (1 << 30))
    taken = prints.filter(drawn).select("fingerprint").toPandas()["fingerprint"].to_numpy(np.int64)
    taken = np.sort(taken.view(np.uint64))  # the same trees in every run
    trees = [Tree(_half(taken, i), -(-n // shard), seed + i) for i in range(2)]
    # The fingerprints of one shard of the first trees and below come to about n / shards, whatever n is.
    open_, done = checkpointed(_routed(prints, trees)), []
    for number in range(1, 1 + ROUNDS):
        sizes = open_.groupBy("tree", "shard").agg(
            F.count_if("home").alias("rows"), F.count("*").alias("visits")
        )
        large = checkpointed(sizes.filter((F.col("rows") > 2 * shard) & (F.col("shard") < 1 << (62 - ROUND_BITS))))
        if large.isEmpty():
            break
        done.append(open_.join(large, ["tree", "shard"], "left_anti"))
        open_ = checkpointed(_split(open_, large, seed + number, shard, sample))
    for part in done:
        open_ = open_.unionByName(part)
    return open_


def linked(prints: DataFrame, seed: int = SEED, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Edges (a, b) that connect the nodes of (node, fingerprint), fingerprints distinct, as their links do."""
    held = in_shards(prints, seed, shard, sample)
    return _blocks(held, 2 * shard).applyInArrow(_match, "a long, b long")


def _grouped(prints: DataFrame) -> DataFrame:
    """(fingerprint, root, component): a group's least fingerprint and doc_id, for all of (doc_id, fingerprint)."""
    named = prints.filter("doc_id IS NOT NULL")
    # A fingerprint is a class and its own node, as several can have one least doc_id.
    classes = checkpointed(
        named.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fingerprint"))
    )
    found = least_reachable(classes.select("node", "least"), linked(classes.select("node", "fingerprint")))
    return found.withColumnRenamed("node", "fingerprint")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, kept for every row.

    Documents whose fingerprints differ in three bits at most are linked, and
    ``component_id`` is the smallest doc_id that links reach; ``kept`` marks the row's
    own. A null, empty or blank text has fingerprint zero, which links like any other.
    Equal fingerprints are compared once, as one class. A row whose doc_id is null is a
    document of its own: component null, kept. Repeated rows get a row each, and texts
    under one doc_id are documents of their own. An empty table gives no rows; other
    columns are ignored. A long text is read in slices. Trees are fitted on samples of
    SAMPLE fingerprints at most; every fingerprint is routed.
    """
    prints = checkpointed(fingerprints(docs))
    out = prints.join(_grouped(prints), "fingerprint", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return out.select(
        "doc_id",
        _hex(F.col("fingerprint")).alias("fingerprint"),
        component.alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component"))).alias("kept"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs with one of each group of near copies: that of the smallest doc_id.

    Where that doc_id has several texts in a group, the row with the least hash stays, so
    reruns agree. Of rows that are equal in all columns one stays. Rows whose doc_id is
    null belong to no group. Nothing else is dropped; an empty table gives no rows. All
    columns stay as they are, whatever their names; maps can be among them.
    """
    row = fresh("row", [*docs.columns, "doc_id", "fingerprint"])
    id_ = fresh("id", [*docs.columns, row])
    # A map has no hash, its JSON has.
    hashed = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    marked = docs.withColumn(row, F.xxhash64(*hashed))
    prints = checkpointed(fingerprints(marked, row))
    named = prints.filter("doc_id IS NOT NULL").join(_grouped(prints), "fingerprint")
    first = named.groupBy("root").agg(F.min(F.struct("doc_id", row)).alias("first")).select("first.*")
    stay = first.unionByName(prints.filter("doc_id IS NULL").select("doc_id", row).distinct())
    # The hash tells a null id from 0, so both can be one key, and one shuffle serves both steps.
    keys = {id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(0))}
    once = marked.withColumns(keys).dropDuplicates([id_, row])
    return once.join(stay.withColumns(keys).select(id_, row), [id_, row], "left_semi").select(*docs.columns)


def _hex(number: Column) -> Column:
    return F.lower(F.lpad(F.hex(number), 16, "0"))
