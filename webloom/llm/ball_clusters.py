"""Centroid clustering in whole numbers, filtered through ball trees.

Every task builds metric trees over bounded runs of its vectors once: a node is a ball with
centre, radius, count and integer sum. A round sends the centroids to the trees. By the
triangle inequality a centroid is out for a whole ball if it is farther from the centre than
the nearest one by more than two radii; a ball with one centroid left is assigned as it
is, with its count and sum, and others are descended to their leaves, where
distances are exact integers. Only a row a tree and centroid leaves a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.runtime import checkpointed, written

SIZE, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Vectors of a tree and of a leaf at most.
TREE, LEAF = 8192, 48
#: Components up to here give squared distances and sums that doubles and longs hold exactly.
TAME = 2**20
#: Rounding moves a distance by far less than this share of what it is made of.
ROUNDING = 1e-9
MOST_LONG = 2**63 - 1
TREES = pa.schema([("ids", pa.binary()), ("known", pa.binary()), ("vectors", pa.binary()), ("kind", pa.string()), ("nodes", pa.binary()), ("balls", pa.binary()), ("sums", pa.binary())])


@dataclass
class Tree:
    """Vectors in the order of the leaves, and balls in the order of their making, each after its parent.

    ``nodes`` has first row, end, and the two children (-1: a leaf) of each ball; ``balls`` its
    centre and radius; ``sums`` the sum of its vectors, exact integers.
    """

    ids: np.ndarray
    known: np.ndarray
    vectors: np.ndarray
    nodes: np.ndarray
    balls: np.ndarray
    sums: np.ndarray


def grown(ids: np.ndarray, known: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> Tree:
    """The ball tree of integer vectors x; ``known`` tells rows with an id."""
    order = np.arange(len(x))
    real = x.astype(np.float64)
    nodes, balls, sums = [], [], []
    todo = [(0, len(x), -1, 0)]
    while todo:
        first, end, parent, side = todo.pop()
        rows = order[first:end]
        centre = real[rows].mean(axis=0)
        apart = np.linalg.norm(real[rows] - centre, axis=1)
        number = len(nodes)
        nodes.append([first, end, -1, -1])
        balls.append(np.append(centre, apart.max()))
        sums.append(x[rows].sum(axis=0))
        if parent >= 0:
            nodes[parent][2 + side] = number
        if end - first > leaf and apart.max() > 0:
            far = real[rows[apart.argmax()]]
            other = real[rows[((real[rows] - far) ** 2).sum(axis=1).argmax()]]
            order[first:end] = rows[np.argsort(real[rows] @ (other - far), kind="stable")]
            middle = (first + end) // 2
            todo += [(first, middle, number, 0), (middle, end, number, 1)]
    return Tree(ids[order], known[order], x[order], np.array(nodes), np.array(balls), np.array(sums))


def squared(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows; Python's integers where doubles would round."""
    if x.dtype != object and z.dtype != object:
        a, b = x.astype(np.float64), z.astype(np.float64)
        return np.rint((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)).astype(np.int64)
    a, b = x.astype(object), z.astype(object)
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)


def assigned(tree: Tree, centroids: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Balls that go to one centroid as a whole, as (ball, centroid); and rows, centroids and distances of the leaves reached."""
    real = centroids.astype(np.float64)
    length = np.linalg.norm(real, axis=1).max()
    centres, radius = tree.balls[:, :-1], tree.balls[:, -1]
    whole, parts = [], []
    # Of equal centroids only the first can win, so the others are out from the start.
    first = np.sort(np.unique(centroids, axis=0, return_index=True)[1]) if centroids.dtype != object else np.arange(len(real))
    todo = [(0, first)]
    while todo:
        ball, near = todo.pop()
        apart = np.linalg.norm(real[near] - centres[ball], axis=1)
        slack = ROUNDING * (length + np.linalg.norm(centres[ball]) + radius[ball])
        near = near[~(apart - radius[ball] > apart.min() + radius[ball] + slack)]  # what overflows stays in
        begin, end, left, right = tree.nodes[ball]
        if len(near) == 1:
            whole.append((ball, int(near[0])))
        elif left >= 0:
            todo += [(left, near), (right, near)]
        else:
            d = squared(tree.vectors[begin:end], centroids[near])
            best = d.argmin(axis=1)  # of equal distances the smaller number
            parts.append((np.arange(begin, end), near[best], d[np.arange(end - begin), best]))
    return whole, parts


def _plain(x: np.ndarray) -> np.ndarray:
    """Integer rows in the narrowest kind that holds them; large ones as Python's integers."""
    if x.dtype == object:
        return x
    top = int(np.abs(x).max()) if x.size else 0
    return x.astype(np.int16 if top < 2**15 else np.int32)


def _bytes(x: np.ndarray) -> bytes:
    return repr(x.tolist()).encode() if x.dtype == object else x.tobytes()


def _array(data: bytes, kind: str, columns: int) -> np.ndarray:
    if kind == "object":
        from ast import literal_eval

        return np.array([[int(v) for v in row] for row in literal_eval(data.decode())], object).reshape(-1, columns)
    return np.frombuffer(data, kind).reshape(-1, columns)


def _integers(batch: pa.RecordBatch) -> np.ndarray:
    """floor(SCALE * x) of the vectors; rows beyond TAME make the whole run one of Python's integers."""
    x = np.floor(SCALE * batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
    return x.astype(np.int64) if not x.size or np.abs(x).max() <= TAME else np.array([[int(v) for v in row] for row in x], object)


def trees(vectors: DataFrame, size: int = SIZE, tree: int = TREE, leaf: int = LEAF) -> DataFrame:
    """A row a ball tree, over runs of at most ``tree`` of the vectors (vec_id, embedding) of a partition."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(run: pa.RecordBatch) -> pa.RecordBatch:
            ids, x = run.column("vec_id"), _integers(run)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            t = grown(ids.fill_null(0).to_numpy(), known, x, leaf)
            x = _plain(t.vectors)
            row = [t.ids.tobytes(), t.known.tobytes(), _bytes(x), x.dtype.name, t.nodes.astype(np.int64).tobytes(), t.balls.tobytes(), _bytes(t.sums)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, TREES, strict=True)], schema=TREES)

        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                taken = batch.slice(0, tree - rows)
                held, rows, batch = [*held, taken], rows + taken.num_rows, batch.slice(taken.num_rows)
                if rows == tree:
                    yield one(pa.concat_batches(held))
                    held, rows = [], 0
        if rows:
            yield one(pa.concat_batches(held))

    return vectors.mapInArrow(build, ", ".join(f"{f.name} {'string' if f.name == 'kind' else 'binary'}" for f in TREES))


def _read(row: dict, size: int) -> Tree:
    kind = row["kind"]
    return Tree(
        np.frombuffer(row["ids"], np.int64),
        np.frombuffer(row["known"], bool),
        _array(row["vectors"], kind, size),
        np.frombuffer(row["nodes"], np.int64).reshape(-1, 4),
        np.frombuffer(row["balls"], np.float64).reshape(-1, size + 1),
        _array(row["sums"], kind if kind == "object" else "int64", size),
    )


def _summed(grove: DataFrame, centroids: np.ndarray, size: int) -> DataFrame:
    """cluster, count, sums of the vectors of each tree that are nearest to a centroid."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = _read(row, size)
                whole, parts = assigned(tree, centroids)
                count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), size), tree.sums.dtype)
                for ball, near in whole:
                    count[near] += tree.nodes[ball, 1] - tree.nodes[ball, 0]
                    total[near] += tree.sums[ball]
                for rows, near, _ in parts:
                    count += np.bincount(near, minlength=len(count))
                    np.add.at(total, near, tree.vectors[rows])
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some), pa.array(count[some]), pa.array([[str(v) for v in r] for r in total[some]], pa.list_(pa.string()))],
                    ["cluster", "count", "sums"],
                )

    return grove.mapInArrow(sums, "cluster long, count long, sums array<string>")


def moved(grove: DataFrame, centroids: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The centroids after a round: exact floor(sum / count) for each that has vectors, the others as they are."""
    wide = "decimal(38,0)"
    each = [F.sum(F.col("sums")[i].cast(wide)).cast("string").alias(f"s{i}") for i in range(size)]
    out = centroids.astype(object)
    for r in _summed(grove, centroids, size).groupBy("cluster").agg(F.sum("count").alias("count"), *each).collect():  # a row a centroid
        out[r.cluster] = [int(r[f"s{i}"]) // r["count"] for i in range(size)]
    return _settled(out)


def _settled(x: np.ndarray) -> np.ndarray:
    """Integer rows as 64-bit integers if these are tame."""
    return x.astype(np.int64) if not x.size or max(abs(int(v)) for v in x.ravel()) <= TAME else x


def nearest(grove: DataFrame, centroids: np.ndarray, size: int = SIZE) -> DataFrame:
    """vec_id, cluster, distance (squared; beyond a long it is clipped to one) for each vector of the trees."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = _read(row, size)
                whole, parts = assigned(tree, centroids)
                for ball, near in whole:
                    rows = np.arange(tree.nodes[ball, 0], tree.nodes[ball, 1])
                    parts.append((rows, np.full(len(rows), near), squared(tree.vectors[rows], centroids[near : near + 1])[:, 0]))
                rows, near, apart = map(np.concatenate, zip(*parts, strict=True))
                apart = np.array([min(int(v), MOST_LONG) for v in apart], np.int64) if apart.dtype == object else apart
                ids = pa.array(tree.ids[rows], mask=~tree.known[rows])
                yield pa.RecordBatch.from_arrays([ids, pa.array(near.astype(np.int32)), pa.array(apart)], ["vec_id", "cluster", "distance"])

    return grove.mapInArrow(tell, "vec_id long, cluster int, distance long")


def usable(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows whose vectors have ``size`` finite components."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(SCALE * v) < F.lit(float("inf"))))
    kept = vectors.filter((F.size("embedding") == size) & finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))


def _started(kept: DataFrame, n: int, size: int, seed: int) -> np.ndarray:
    """The first centroids: the n vectors of least hash, in that order; those without an id come last."""
    own: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(own.alias("hash"), "embedding").orderBy(F.asc_nulls_last("hash"), "embedding").limit(n).collect()
    x = [[int(np.floor(SCALE * v)) for v in r.embedding] for r in first]
    return _settled(np.array(x, object).reshape(-1, size))


def clusters(
    vectors: DataFrame, n: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, seed: int = SEED, tree: int = TREE, leaf: int = LEAF
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia) a vector of (vec_id, embedding), and the final centroids.

    Components count as floor(256 * x). Vectors that are null, of another length or hold a null or
    a component that is not finite take no part and get no row. Centroids start as the n vectors of
    least sha256 of ``seed:vec_id``; rows of one hash go by their components, and rows
    without an id come last, but are clustered like others and keep their null id. Fewer than n vectors are as many
    centroids. Repeated rows are vectors of their own; of equal centroids the later ones stay empty
    and where they are. An empty table gives no rows; other columns are ignored. Squared distances and
    inertias beyond a long are clipped to one; a component that is not finite times 256 counts as not finite.
    """
    kept = usable(vectors, size)
    grove = written(trees(kept, size, tree, leaf))
    centroids = _started(kept, n, size, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(grove, centroids, size)
    each = checkpointed(nearest(grove, centroids, size))
    wide, most = F.sum(F.col("distance").cast("decimal(38,0)")), F.lit(MOST_LONG)
    sums = written(each.groupBy("cluster").agg(wide.alias("sum")))
    total = sums.agg(F.sum("sum")).first()[0] or 0
    out = each.join(sums, "cluster").select(
        "vec_id",
        "cluster",
        "distance",
        F.least("sum", most.cast("decimal(38,0)")).cast("long").alias("cluster_inertia"),
        F.lit(min(int(total), MOST_LONG)).cast("long").alias("inertia"),
    )
    return out, centroids


def centroid_digests(centroids: np.ndarray) -> list[str]:
    """The sha256 of each centroid's components, as decimal integers joined by commas."""
    return [hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest() for row in centroids]
