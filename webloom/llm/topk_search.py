"""Exact top-k search by inner product, pruned with multi-resolution segment statistics.

A vector is cut into segments, and each segment of length L keeps its mean times
sqrt(L) and its deviation times sqrt(L). The distance of two such summaries is at most
the distance of the vectors, and a summary has its vector's length, so

    q.c = (|q|^2 + |c|^2 - |q - c|^2) / 2 <= summary(q).summary(c).

A query's first threshold is its k-th exact score in a small sample of the candidates, so every
visit is pruned. Whole cells are bounded first. Candidates go to the cell of the nearest
pivot, in summaries of CELL_LEVEL segments; with r the largest distance in a cell,
q.c <= summary(q).pivot + |q| r for all its members. A query first visits the cells of
highest bound that hold k candidates; their exact scores raise its threshold. It then
visits only the other cells whose bound reaches the threshold, so a cell that no query
can need is not shuffled to it. There are about sqrt(n) / 2 cells, whatever n is.

Inside a cell, levels go from few segments to many: a candidate whose bound is below
the threshold on any level is out. Of the pairs that the last level leaves, those of highest
bound are scored first, which raises the threshold once more; then the pairs that are still
open are, and no others. Cells of any size are split into chunks, and the queries of a cell
into blocks; each pair of a chunk and a block is one group of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.runtime import checkpointed

K, SCALE, LEVELS, CELL_LEVEL = 10, 1024, (4, 8, 16), 16
#: Pivots that a task holds at most, vectors of the sample for thresholds and the largest share of all vectors that it
#: is, rows of a block of queries and of a chunk of candidates, queries in one go.
CELLS, SAMPLE, SAMPLE_SHARE, QUERY_BLOCK, BLOCK, STEP = 32_768, 512, 1 / 16, 32_768, 65_536, 32
MOST_LONG = 2**63 - 1
#: Rounding moves a bound by far less than this share of the vectors' lengths.
ROUNDING = 1e-9


def summary(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments of each row, times the roots of their lengths."""
    cuts = np.unique(np.linspace(0, x.shape[1], segments + 1).astype(int))
    parts = [x[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    mean = np.stack([p.sum(axis=1) / math.sqrt(p.shape[1]) for p in parts], axis=1)
    spread = np.stack([np.linalg.norm(p - p.mean(axis=1, keepdims=True), axis=1) for p in parts], axis=1)
    return np.concatenate([mean, spread], axis=1)


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products. Rows too large for exact doubles go by Python's integers, clipped to a long."""
    tame = 2.0**26 / math.sqrt(q.shape[1])
    big_q, big_c = np.abs(q).max(axis=1) > tame, np.abs(c).max(axis=1) > tame
    if not big_q.any() and not big_c.any():
        return np.rint(q @ c.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    out = np.zeros((len(q), len(c)), np.int64)
    out[np.ix_(~big_q, ~big_c)] = np.rint(q[~big_q] @ c[~big_c].T).astype(np.int64)
    for rows, columns in ((big_q, np.ones(len(c), bool)), (~big_q, big_c)):
        if rows.any() and columns.any():
            found = whole(q[rows]) @ whole(c[columns]).T
            out[np.ix_(rows, columns)] = np.clip(found, -MOST_LONG - 1, MOST_LONG).astype(np.int64)
    return out


def scaled(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows of floor(SCALE * x)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)
    return np.floor(SCALE * x)


def search(
    q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int
) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]:
    """For each query its place, its k best candidates' places and their scores; and the pairs left by each step.

    c_ids ascend; rows of a query's own id are no candidates. ``least`` are scores that
    k candidates of a query are known to reach, minus infinity if none is known; pairs
    are counted before, after each level, and as scored.
    """
    levels = [(summary(q, n), summary(c, n)) for n in LEVELS]
    q_norm, c_norm = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    found, left = [], np.zeros(len(LEVELS) + 2, np.int64)
    for at in range(0, len(q), STEP):
        rows = slice(at, at + STEP)
        open_ = q_ids[rows, None] != c_ids
        columns = np.arange(len(c))
        left[0] += open_.sum()
        for level, (q_level, c_level) in enumerate(levels):
            bound = q_level[rows] @ c_level[columns].T + ROUNDING * q_norm[rows, None] * c_norm[columns]
            open_ &= ~(bound < least[rows, None])
            kept = open_.any(axis=0)
            open_, columns, bound = open_[:, kept], columns[kept], bound[:, kept]
            left[level + 1] += open_.sum()
        for i, own in enumerate(open_):
            place, reach = columns[own], bound[i, own]
            early = np.ones(len(place), bool)
            if len(place) > 2 * k:
                early = reach >= np.partition(reach, len(reach) - 2 * k)[len(reach) - 2 * k]
            score = exact_scores(q[at + i : at + i + 1], c[place[early]])[0]
            if not early.all():
                kth = float(np.partition(score, len(score) - k)[len(score) - k])
                later = ~early & ~(reach < kth - abs(kth) * ROUNDING)
                place = np.concatenate([place[early], place[later]])
                score = np.concatenate([score, exact_scores(q[at + i : at + i + 1], c[place[len(score) :]])[0]])
                order = np.argsort(place)
                place, score = place[order], score[order]
            left[-1] += len(place)
            if len(place) > k:
                top = score >= np.partition(score, len(score) - k)[len(score) - k]
                place, score = place[top], score[top]
            best = np.argsort(~score, kind="stable")[:k]  # ~score falls as score rises and can't overflow
            found.append((at + i, place[best], score[best]))
    return found, left


class Cells:
    """Pivots by vector length, each with its cell's number, largest distance and rows.

    Cell 0 takes vectors of a length without a pivot and is never ruled out.
    """

    def __init__(self, sample: np.ndarray) -> None:
        self.pivots: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        number = 1
        for length in sorted({len(x) for x in sample}):
            own = np.unique(summary(np.array([x for x in sample if len(x) == length]), CELL_LEVEL), axis=0)
            self.pivots[length] = np.arange(number, number + len(own)), own
            number += len(own)
        self.radius, self.rows = np.zeros(number), np.zeros(number, np.int64)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of one length, the cell of each and the distance to its pivot."""
        if x.shape[1] not in self.pivots:
            return np.zeros(len(x), np.int64), np.zeros(len(x))
        numbers, pivots = self.pivots[x.shape[1]]
        place = summary(x, CELL_LEVEL)
        near = ((pivots**2).sum(axis=1) - 2 * (place @ pivots.T)).argmin(axis=1)
        return numbers[near], np.linalg.norm(place - pivots[near], axis=1)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells with rows that queries of one length can find something in, and the bound of each query in each."""
        numbers, pivots = self.pivots.get(q.shape[1], (np.zeros(0, np.int64), np.zeros((0, 0))))
        norm = np.linalg.norm(q, axis=1)[:, None]
        reach = self.radius[numbers] + ROUNDING * (self.radius[numbers] + np.linalg.norm(pivots, axis=1))
        bound = summary(q, CELL_LEVEL) @ pivots.T + norm * reach if len(numbers) else np.zeros((len(q), 0))
        numbers = np.append(0, numbers)
        bound = np.concatenate([np.full((len(q), 1), np.inf), bound], axis=1)
        some = self.rows[numbers] > 0
        return numbers[some], bound[:, some]

    def first(self, numbers: np.ndarray, bound: np.ndarray, k: int) -> np.ndarray:
        """Whether a query visits each cell first: those of highest bound that hold more than k rows together."""
        order = np.argsort(-bound, axis=1, kind="stable")
        rows = self.rows[numbers][order]
        early = np.cumsum(rows, axis=1) - rows <= k
        out = np.zeros(bound.shape, bool)
        np.put_along_axis(out, order, early, axis=1)
        return out


def _with(df: DataFrame, **more: str) -> str:
    """The schema of df with more columns."""
    return ", ".join([*(f"{name} {kind}" for name, kind in df.dtypes), *(f"{name} {kind}" for name, kind in more.items())])


def _by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = batch.column("length").to_numpy()
    for size in np.unique(sizes):
        yield batch.filter(pa.array(sizes == size))


def _fitted(vectors: DataFrame, cell_rows: int | None) -> tuple[DataFrame, Cells, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """vectors with their cells, those, and by length ids and integer components of the sample for thresholds.

    The driver gets a sample of SAMPLE vectors and one of a pivot a cell, by hash, and a row a cell.
    """
    n = vectors.count()
    wanted = min(CELLS, -(-n // cell_rows) if cell_rows else math.ceil(math.sqrt(n) / 2))
    aim = max(wanted, min(SAMPLE, n * SAMPLE_SHARE))
    order = F.shiftrightunsigned(F.xxhash64(F.lit(7), "vec_id", "embedding"), 33)
    low = order < F.lit(int(min(1.0, aim / max(n, 1)) * (1 << 31)))
    drawn = vectors.filter(low).select("vec_id", "embedding", order.alias("order")).orderBy("order").limit(2 * CELLS).toPandas()
    sample = [np.floor(SCALE * np.array(x, np.float64)) for x in drawn["embedding"]]
    cells = Cells(sample[:wanted])
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    few = range(min(len(sample), max(int(min(SAMPLE, n * SAMPLE_SHARE)), 1)))
    for length in {len(sample[i]) for i in few}:
        own = [i for i in few if len(sample[i]) == length]
        known[length] = drawn["vec_id"].to_numpy(np.int64)[own], np.array([sample[i] for i in own])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_length(batch):
                cell, apart = cells.nearest(scaled(part.column("embedding")))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cell), pa.array(apart)], [*part.schema.names, "cell", "apart"]
                )

    celled = checkpointed(vectors.mapInArrow(place, _with(vectors, cell="long", apart="double")))
    for r in celled.groupBy("cell").agg(F.max("apart").alias("radius"), F.count("*").alias("rows")).collect():
        cells.radius[r.cell], cells.rows[r.cell] = r.radius, r.rows
    return celled, cells, known


def _thresholds(queries: DataFrame, known: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """queries with ``least``: a score that k vectors of the sample reach, minus infinity where it has no k of the query's length."""

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_length(batch):
                q, ids = scaled(part.column("embedding")), part.column("query_id").to_numpy()
                least = np.full(len(q), -np.inf)
                own_ids, x = known.get(q.shape[1], (np.zeros(0, np.int64), q[:0]))
                for at in range(0, len(q), 4096) if len(x) >= k else ():
                    scores = exact_scores(q[at : at + 4096], x)
                    scores[ids[at : at + 4096, None] == own_ids] = -MOST_LONG - 1
                    kth = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k]
                    low = kth - np.abs(kth.astype(float)) * ROUNDING
                    least[at : at + 4096] = np.where(kth > -MOST_LONG - 1, low, -np.inf)
                yield part.append_column("least", pa.array(least))

    return queries.mapInArrow(reach, _with(queries, least="double"))


def _visits(queries: DataFrame, cells: Cells, k: int, first: bool) -> DataFrame:
    """A row of queries, which have ``least``, for each cell to visit first, or later."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_length(batch):
                q, least = scaled(part.column("embedding")), part.column("least").to_numpy(zero_copy_only=False)
                for at in range(0, len(q), 4096):
                    rows = slice(at, at + 4096)
                    numbers, bound = cells.bounds(q[rows])
                    early = cells.first(numbers, bound, k)
                    row, cell = np.nonzero(early if first else ~early & ~(bound < least[rows, None]))
                    taken = part.take(pa.array(row + at))
                    yield pa.RecordBatch.from_arrays(
                        [*taken.columns, pa.array(numbers[cell])], [*taken.schema.names, "cell"]
                    )

    return queries.mapInArrow(route, _with(queries, cell="long"))


def _found(visits: DataFrame, celled: DataFrame, cells: Cells, k: int, query_block: int, block: int) -> DataFrame:
    """query_id, query, vec_id, score: the k best of each visit's chunks."""
    chunks = np.maximum(-(-cells.rows // block), 1)
    blocks = np.zeros(len(chunks), np.int64)
    for r in visits.groupBy("cell").count().collect():  # a row a cell
        blocks[r.cell] = -(-r["count"] // query_block)

    def sized(df: DataFrame, own: str, hashed_by: list[str], n: np.ndarray, other: str, m: np.ndarray) -> DataFrame:
        """df with a place in the cell's n parts of its own side and a row for each of the m parts of the other side."""

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, number = (batch.column(c).to_numpy() for c in ("cell", "hashed"))
                row = np.repeat(np.arange(len(cell)), m[cell])
                part = np.arange(len(row)) - np.repeat(np.cumsum(m[cell]) - m[cell], m[cell])
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(number[row] % np.maximum(n[cell[row]], 1)), pa.array(part)],
                    [*taken.schema.names, own, other],
                )

        hashed = df.withColumn("hashed", F.shiftrightunsigned(F.xxhash64(*hashed_by), 1))
        return hashed.mapInArrow(deal, _with(hashed, **{own: "long", other: "long"}))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        out = [none], [none], [none]
        if left.num_rows and right.num_rows:
            order = np.argsort(right.column("vec_id").to_numpy(), kind="stable")
            c_ids, c = right.column("vec_id").to_numpy()[order], scaled(right.column("embedding"))[order]
            least = left.column("least").to_numpy()
            found, _ = search(left.column("query_id").to_numpy(), scaled(left.column("embedding")), least, c_ids, c, k)
            out = tuple(zip(*((np.full(len(at), i), c_ids[at], score) for i, at, score in found), strict=True))
        row, vec_id, score = map(np.concatenate, out)
        asked = left.select(["query_id", "query"]).take(pa.array(row.astype(np.int64)))
        return pa.table([*asked.columns, pa.array(vec_id), pa.array(score)], ["query_id", "query", "vec_id", "score"])

    keys = ["length", "cell", "q_block", "chunk"]
    asked = sized(visits, "q_block", ["query_id", "query"], blocks, "chunk", chunks).select(*keys, "query_id", "query", "least", "embedding")
    held = sized(celled, "chunk", ["vec_id", "embedding"], chunks, "q_block", blocks).select(*keys, "vec_id", "embedding")
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(
        best, "query_id long, query long, vec_id long, score long"
    )


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    query_block: int = QUERY_BLOCK,
    block: int = BLOCK,
    cell_rows: int | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k best by integer inner product.

    Components x count as floor(1024 * x). Ties go to the smaller vec_id; a query with
    fewer candidates gets them all. Vectors that are null, empty or hold a null or a
    component that is not finite take no part, nor do rows whose vec_id is null;
    vectors of another length are no candidates. Rows of the query's own vec_id are not
    its candidates. Rows that are equal in id and vector count once; different vectors
    under one vec_id are candidates, and queries, of their own. Scores beyond a long are
    clipped to it. Empty tables give no rows; other columns are ignored. A cell aims at ``cell_rows``,
    twice the root of the number of vectors if none is given.
    """

    def usable(rows: DataFrame) -> DataFrame:
        x = F.col("embedding").cast("array<double>")
        finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
        return (
            rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").cast("long").alias("length"))
            .filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite)
            .distinct()
        )

    celled, cells, known = _fitted(usable(vectors), cell_rows)
    asked = _thresholds(usable(queries).withColumnRenamed("vec_id", "query_id").withColumn("query", F.xxhash64("embedding")), known, k)
    ranked = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)

    first_visits = _visits(asked, cells, k, True)
    first = checkpointed(top(_found(first_visits, celled, cells, k, query_block, block)))
    # The score of the k-th found is a threshold. As a double it must not be above the score, and a clipped one says nothing.
    least = F.when(F.col("score") > -MOST_LONG - 1, F.col("score") - F.abs(F.col("score").cast("double")) * ROUNDING)
    kth = first.filter(F.col("rank") == k).select("query_id", "query", least.alias("raised"))
    raised = asked.join(kth, ["query_id", "query"], "left").withColumn("least", F.greatest("least", "raised"))
    later = _found(_visits(raised.select(*asked.columns), cells, k, False), celled, cells, k, query_block, block)
    return top(first.drop("rank").unionByName(later)).select("query_id", "rank", "vec_id", "score")
