"""What filters of documents remove, in every order of applying them.

Four filters look at a text alone; the fifth removes a text that a smaller doc_id also has.
For that one, rows are range-sorted by text fingerprint, full text and doc_id, and each row
is compared with its predecessor. Bounds of partitions are drawn by fingerprint (SHA-256) and
doc_id alone, so the driver's sample holds no texts. Where a partition goes on with the last
text of the one before, pairs of neighbouring partitions compare those texts, and the least
doc_id of the run is handed on; the driver sees three numbers a partition.

A document is then a mask of its failures. Masks are counted by part, which adds up across
tasks, and every order of the filters is worked out from these counts alone.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.runtime import written

#: The filters by their letters; bit i of a mask is the i-th.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
#: Bytes of a text whose words are looked at in one go, and rows of a batch that a task returns.
SLICE, OUT_ROWS = 1 << 20, 8192
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_NOT_CAPITALS = bytes(set(range(256)) - set(range(65, 91)))
_NOT_SIGNS = bytes(set(range(256)) - set(b"#$%&*|"))
_NOT_STARTS = bytes(range(0x80, 0xC0))  # bytes that go on a code point

OUT = pa.schema([("pid", pa.int64()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("first_run", pa.bool_()), ("edge", pa.int32()), ("text", pa.binary()), ("least", pa.int64())])
MASKS = "pid long, doc_id long, part string, mask int, first_run boolean, edge int, text binary, least long"
LAST, FIRST, BOTH = 1, 2, 3


def failures(text: bytes) -> int:
    """The mask of filters A to D that a text in UTF-8 fails; beside its distinct words, memory is bounded."""
    n, distinct, at = 0, set(), 0
    while at < len(text):
        cut = _SPACE.search(text, at + SLICE)
        end = cut.start() if cut else len(text)
        words = text[at:end].split()
        n += len(words)
        distinct.update(words)
        at = end
    capitals, points = len(text.translate(None, _NOT_CAPITALS)), len(text.translate(None, _NOT_STARTS))
    tests = (n < LEAST_WORDS, 100 * len(distinct) < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * points, bool(text.translate(None, _NOT_SIGNS)))
    return sum(failed << i for i, failed in enumerate(tests))


def _sorted_masks(docs: DataFrame) -> DataFrame:
    """A row a document with its mask, as far as its partition tells, and edges: first and last texts of partitions.

    ``first_run`` marks rows of a partition's first text; an edge's ``least`` is the least doc_id of its text there.
    """
    bit = 1 << FILTERS.index("E")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        run, number, fails, first, rows = None, None, 0, None, []

        def batch_of(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), OUT, strict=True)], schema=OUT)

        runs, least = 0, None
        for batch in batches:
            for print_, text, doc_id, part in zip(*(batch.column(c) for c in ("print", "text", "doc_id", "part")), strict=True):
                print_, text, doc_id = print_.as_py(), text.as_py(), doc_id.as_py()
                if print_ != number or text != run:
                    if runs == 1:
                        first = run, least
                    run, number, fails, least, runs = text, print_, failures(text), None, runs + 1
                if least is None:
                    least = doc_id
                later = doc_id is not None and least is not None and doc_id > least
                rows.append((pid, doc_id, part.as_py(), fails | bit * later, runs == 1, None, None, None))
                if len(rows) == OUT_ROWS:
                    yield batch_of(rows)
                    rows = []
        if runs == 1:
            rows.append((pid, None, None, None, None, BOTH, run, least))
        elif runs:
            rows += [(pid, None, None, None, None, FIRST, *first), (pid, None, None, None, None, LAST, run, least)]
        if rows:
            yield batch_of(rows)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.unhex(F.sha2(text, 256)).alias("print"),
        text.cast("binary").alias("text"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.monotonically_increasing_id().alias("at"),  # rows that are equal otherwise can be split, too
    )
    last = [F.asc_nulls_last("doc_id"), "at"]
    return rows.repartitionByRange("print", *last).sortWithinPartitions("print", "text", *last).mapInArrow(compare, MASKS)


def _handed_on(edges: DataFrame) -> list[tuple[int, int]]:
    """(pid, least doc_id) of partitions whose first text goes on from the one before, the least of its whole run.

    Neighbours are partitions that have rows. Their texts are compared in pairs; only numbers reach the driver.
    """
    parts = edges.groupBy("pid").agg(F.max("edge").alias("most")).orderBy("pid").collect()  # a row a partition
    number = {r.pid: i for i, r in enumerate(parts)}
    if len(parts) < 2:
        return []
    places = edges.sparkSession.createDataFrame(list(number.items()), "pid long, place long")
    placed = edges.join(places, "pid")
    before = placed.filter(F.col("edge") != FIRST).select((F.col("place") + 1).alias("place"), F.col("text").alias("text_before"))
    after = placed.filter(F.col("edge") != LAST)
    same = after.join(before, "place").filter("text = text_before").select("place", "pid", "edge")
    goes_on = {r.place: (r.pid, r.edge) for r in same.collect()}
    ends = {number[r.pid]: r.least for r in edges.filter(F.col("edge") != FIRST).select("pid", "least").collect()}
    starts = {number[r.pid]: r.least for r in edges.filter(F.col("edge") == BOTH).select("pid", "least").collect()}
    out, run = [], {}
    for place in range(len(parts)):
        if place in goes_on:
            pid, edge = goes_on[place]
            least = run.get(place - 1, ends.get(place - 1))
            if least is None and edge == BOTH:
                least = starts[place]
            out.append((pid, least))
            if edge == BOTH:
                run[place] = least
    return [(pid, least) for pid, least in out if least is not None]


def failure_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part (its lang, a null one as an empty string), mask for every row of docs (doc_id, text, lang).

    Bits A to E of the mask are the filters that the row fails. A null text is empty. A row fails E if a
    smaller doc_id has the same text, so rows that repeat a doc_id don't fail by each other, and a null
    doc_id neither fails nor makes others fail.
    """
    found = written(_sorted_masks(docs))
    handed = _handed_on(found.filter("edge IS NOT NULL").select("pid", "edge", "text", "least"))
    rows = found.filter("edge IS NULL").select("pid", "doc_id", "part", "mask", "first_run")
    if handed:
        # At most a row a partition.
        least = written(docs.sparkSession.createDataFrame(handed, "pid long, handed long"))
        rows = rows.join(least, "pid", "left")
        late = F.col("first_run") & (F.col("doc_id") > F.col("handed"))
        rows = rows.withColumn("mask", F.when(F.coalesce(late, F.lit(False)), F.col("mask").bitwiseOR(1 << FILTERS.index("E"))).otherwise(F.col("mask")))
    return rows.select("doc_id", "part", "mask")


def _orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bit, bits of the filters before) for each step of each order."""
    out = []
    for order in map("".join, itertools.permutations(FILTERS)):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            out.append((order, step, bit, before))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts of every part, order of the filters and step; all 600 rows of each part that docs have.

    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    Masks are as in ``failure_masks``. A document is good or toxic if any row of labels (doc_id, quality,
    toxic) says 1 for its doc_id; repeated labels count once, null doc_ids match none. ``shapley``
    is what the step's filter removes, summed over all orders. Empty docs give no rows, empty
    labels no losses; other columns are ignored.
    """
    told = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    told = told.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    masks = failure_masks(docs).join(told, "doc_id", "left")
    counts = masks.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )
    # 32 masks a part at most, with 80 pairs of a filter and those before it.
    pairs = sorted({(bit, before) for _, _, bit, before in _orders()})
    each = F.explode(F.array(*(F.struct(F.lit(bit).alias("bit"), F.lit(before).alias("before")) for bit, before in pairs)))
    wide = written(counts).select("*", each.alias("pair")).select("*", "pair.*")
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    earlier = F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda what, when: F.sum(F.when(when, F.col(what)).otherwise(0))
    steps = wide.groupBy("part", "bit", "before").agg(
        total("n", ~fails & ~earlier).alias("kept"),
        total("n", fails & ~earlier).alias("removed"),
        total("n", fails & earlier).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", fails & ~earlier).alias("good_lost"),
        total("toxic", fails & ~earlier).alias("toxic_lost"),
    )
    # As many orders have a filter at this step behind just these others.
    others = F.bit_count("before")
    orders = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS)))), others + 1)
    shapley = F.sum(F.col("removed") * orders).over(Window.partitionBy("part", "bit"))
    names = docs.sparkSession.createDataFrame(_orders(), "filter_order string, step int, bit int, before int")
    return steps.withColumn("shapley", shapley).join(names, ["bit", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
