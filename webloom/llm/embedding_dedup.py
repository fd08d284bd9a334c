"""Near-duplicate embeddings by counting collisions of projections.

Unit vectors are projected on many random lines. Two vectors collide on a line if one
lies in the window around the other; the differences of a pair at the link threshold
are normal with a known deviation, so the share of collisions is known too, and the
count a pair must reach is the largest that such pairs reach with the wanted recall.
On the first lines windows are so wide that a pair at the threshold is in all of them: one line is
sorted, its windows are runs, and the next lines thin out what is left to a few of a hundred pairs. Only
these are counted, and a pair is dropped as soon as the lines that are left can't bring it to
the count. Pairs that reach it are verified by their exact cosine.

Pairs are looked for in cells. A label of a few thousand vectors is one cell. The vectors of a larger
one go to several tables; a cell of a table is a run of CELL_WIDTH on each of ``depth``
lines of that table, with a seeded offset. The depth grows with the logarithm of the
label, so cells keep their size, and the tables are as many as pairs at the threshold
need to share a cell in one of them with the wanted recall, however large a label is. A pair that
shares several cells counts in the first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.blocks import Forest, in_blocks
from webloom.llm.components import least_reachable
from webloom.llm.runtime import checkpointed

COSINE, LINES, RECALL, SEED, CHUNK = 0.93, 32, 0.99, 42, 2048
#: Lines whose windows a pair must be in, and half widths of windows in deviations of a pair at the threshold: theirs, those of the lines counted.
SORTED, FIRST, WINDOW = 5, 3.0, 1.34
#: Vectors that a cell aims at, width of a cell on a line in deviations of all vectors, recall of the tables.
CELL_ROWS, CELL_WIDTH, TABLE_RECALL = 8192, 2.0, 0.995


def wanted_count(lines: int = LINES, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with probability recall."""
    p, reached = math.erf(WINDOW / math.sqrt(2)), 0.0
    for count in range(lines, 0, -1):
        reached += math.comb(lines, count) * p**count * (1 - p) ** (lines - count)
        if reached >= recall:
            return count
    return 0


def _projected(x: np.ndarray, seed: int) -> np.ndarray:
    """Rows of x, scaled to length one, on the first and the other lines."""
    lines = np.random.default_rng(seed).standard_normal((x.shape[1], SORTED + LINES))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ lines


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def sizes_of_tables(rows: int, cosine: float, cell_rows: int = CELL_ROWS) -> tuple[int, int]:
    """Lines of a cell and tables for a label of so many vectors."""
    # Differences of two vectors on a line: normal with deviation sqrt(2), and apart at the threshold.
    alone, near = (_share(d) for d in (math.sqrt(2), math.sqrt(2 - 2 * cosine)))
    depth = max(0, math.ceil(math.log(max(rows, 1) / cell_rows) / -math.log(alone)))
    return depth, math.ceil(math.log(1 - TABLE_RECALL) / math.log1p(-(near**depth))) if depth else 1


def _share(deviation: float) -> float:
    """How often two places whose difference is normal fall in one run of CELL_WIDTH with a random offset."""
    w = CELL_WIDTH / deviation
    return math.erf(w / math.sqrt(2)) - 2 / (w * math.sqrt(2 * math.pi)) * (1 - math.exp(-w * w / 2))


def cells(x: np.ndarray, depth: int, tables: int, seed: int) -> np.ndarray:
    """The cell of each row of x in each table."""
    if not depth:
        return np.zeros((len(x), 1), np.int64)
    rng = np.random.default_rng(seed + 1)
    out = np.zeros((len(x), tables), np.uint64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for table in range(tables):
        lines, offset = rng.standard_normal((x.shape[1], depth)), rng.random(depth)
        for place in np.floor(unit @ lines / CELL_WIDTH + offset).astype(np.int64).T:
            out[:, table] = (out[:, table] ^ place.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out[:, table] ^= out[:, table] >> np.uint64(29)
    return out.view(np.int64)


def _celled(classes: DataFrame, cosine: float, seed: int, cell_rows: int) -> DataFrame:
    """classes, which have ``rows`` of their label, once for each table, with ``depth``, ``table`` and ``at``, the cell."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, kind = np.unique(
                np.stack([batch.column(c).to_numpy() for c in ("size", "rows")], axis=1), axis=0, return_inverse=True
            )
            for i, (_, rows) in enumerate(kinds):
                part = batch.filter(pa.array(kind.ravel() == i)).drop_columns(["rows"])
                depth, tables = sizes_of_tables(int(rows), cosine, cell_rows)
                at = cells(_vectors(part.column("embedding")), depth, tables, seed)
                for table in range(tables):
                    more = [np.full(part.num_rows, v) for v in (depth, table)] + [at[:, table]]
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, *map(pa.array, more)], [*part.schema.names, "depth", "table", "at"]
                    )

    kinds = "label long, size long, embedding array<double>, node long, copies long, depth long, table long, at long"
    return classes.select("label", "size", "embedding", "node", "copies", "rows").mapInArrow(place, kinds)


def in_windows(on: np.ndarray, rows: np.ndarray, others: np.ndarray, apart: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in rows and in others of the pairs that are in each other's windows on all sorted lines."""
    i, j = np.nonzero(np.abs(on[rows, 0][:, None] - on[others, 0]) <= FIRST * apart)
    for line in range(1, SORTED):
        kept = np.abs(on[rows[i], line] - on[others[j], line]) <= FIRST * apart
        i, j = i[kept], j[kept]
    return i, j


def reaching(on: np.ndarray, a: np.ndarray, b: np.ndarray, apart: float, wanted: int) -> np.ndarray:
    """The places of the pairs (a, b) that collide on ``wanted`` of the lines counted."""
    open_, count = np.arange(len(a)), np.zeros(len(a), np.int16)
    for line in range(LINES):
        count += np.abs(on[a[open_], SORTED + line] - on[b[open_], SORTED + line]) <= WINDOW * apart
        if line % 4 == 3 or line == LINES - 1:
            can = count + (LINES - 1 - line) >= wanted
            open_, count = open_[can], count[can]
    return open_


def _matcher(cosine: float, seed: int):
    """The function of one block: link counts (a, null, n) and forest edges (a, b, null)."""
    apart, wanted = math.sqrt(2 - 2 * cosine), wanted_count()

    def match(table: pa.Table) -> pa.Table:
        x = _vectors(table.column("embedding"))
        norm, on = np.linalg.norm(x, axis=1), _projected(x, seed).astype(np.float32)
        node, copies = (table.column(c).to_numpy() for c in ("node", "copies"))
        depth, number = (table.column(c)[0].as_py() for c in ("depth", "table"))
        before = cells(x, depth, number, seed) if number else None
        own, lo, hi = (table.column(c).to_numpy() for c in ("own", "lo", "hi"))
        same = lo[0] == hi[0]
        left, right = ((s := np.flatnonzero(own == end))[np.argsort(on[s, 0])] for end in (lo, hi))
        first, links, forest = on[right, 0], np.zeros(len(x), np.int64), Forest(len(x))
        for at in range(0, len(left), 128):
            rows = left[at : at + 128]
            reach = on[rows, 0]
            begin = np.searchsorted(first, reach[0] - FIRST * apart)
            end = np.searchsorted(first, reach[-1] + FIRST * apart, "right")
            others = right[begin:end]
            i, j = in_windows(on, rows, others, apart)
            once = rows[i] < others[j] if same else rows[i] != others[j]
            i, j = i[once], j[once]
            kept = reaching(on, rows[i], others[j], apart, wanted)
            i, j = i[kept], j[kept]
            if not len(i):
                continue
            if 8 * len(i) > len(rows) * len(others):  # many copies: a product takes less memory than their pairs
                dot = (x[rows] @ x[others].T)[i, j]
            else:
                dot = np.einsum("ij,ij->i", x[rows[i]], x[others[j]])
            near = dot / (norm[rows[i]] * norm[others[j]]) >= cosine
            if before is not None:  # pairs that share a cell of an earlier table count there
                near[near] = (before[rows[i[near]]] != before[others[j[near]]]).all(axis=1)
            i, j = i[near], j[near]
            np.add.at(links, rows[i], copies[others[j]])
            np.add.at(links, others[j], copies[rows[i]])
            for row in np.unique(i):
                forest.link(rows[row], others[j[i == row]])
        some = np.flatnonzero(links)
        a, b = forest.edges()
        none = np.zeros(len(some), np.int64)
        return pa.table(
            {
                "a": pa.array(np.concatenate([node[some], node[a]]), pa.int64()),
                "b": pa.array(np.concatenate([none, node[b]]), pa.int64(), mask=np.arange(len(some) + len(a)) < len(some)),
                "n": pa.array(np.concatenate([links[some], np.zeros(len(a), np.int64)]), pa.int64()),
            }
        )

    return match


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, seed: int = SEED, chunk: int = CHUNK, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label).

    Rows of one label link at a cosine of ``cosine`` or more in double precision.
    Equal vectors of a label are one class and always link; classes are compared. A
    vector that is null, empty, all zero or holds a null or a component that is not
    finite links with nothing, and so does a row with a null label or vec_id (whose
    component is null; it is not kept). Vectors of unequal lengths do not link. A
    repeated row is another vector, and so is another vector under a repeated vec_id.
    An empty table gives no rows; other columns are ignored. No pair below the threshold
    is linked; one at it is found with probability RECALL times that of the first windows
    (0.987) and, in labels of more than ``cell_rows`` classes, TABLE_RECALL; closer ones
    more surely.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0)
    usable = usable & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.when(usable, x).alias("embedding"),
    )
    usable_rows = rows.filter("embedding IS NOT NULL")
    # A class is numbered, as several can have one least vec_id; the checkpoint fixes the numbers.
    classes = checkpointed(
        usable_rows.groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .select("label", F.size("embedding").cast("long").alias("size"), "embedding", "least", "copies")
        .withColumn("node", F.monotonically_increasing_id())
    )
    in_label = classes.groupBy("label").agg(F.count("*").alias("rows"))
    celled = _celled(classes.join(in_label, "label"), cosine, seed, cell_rows)
    found = checkpointed(
        in_blocks(celled, ["label", "size", "depth", "table", "at"], "node", chunk).applyInArrow(
            _matcher(cosine, seed), "a long, b long, n long"
        )
    )
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    component = least_reachable(classes.select("node", "least"), found.filter("b IS NOT NULL").select("a", "b"))
    told = (
        classes.join(links, "node", "left")
        .join(component, "node")
        .select(
            "label",
            "embedding",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
            "component",
        )
    )
    return rows.join(told, ["label", "embedding"], "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
