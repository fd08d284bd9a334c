"""Packing by lexical retrieval.

Documents are encoded once. A document first fills whole windows of its own; what is left
of it, its rest, is packed with others. Document frequencies and the mean length count
the rests of all documents. Rests are dealt to shards of bounded size by a lexical key:
of a rest's terms of most BM25 weight, the first two in one fixed order. Rests that
share such terms therefore stand in one shard or, where a key holds more than a shard,
in shards of that key alone. Small groups share a shard. A document that stands so often
that its copies would overfill a shard is dealt in portions.

A BM25 inverted index covers the rests of a shard. The longest unused rest becomes a seed; the index ranks the
other unused rests by the seed's terms, and they fill the seed's window in that order:
first every rest that fits whole, then the best that is left is cut to fill the window.
Only the last window of a shard can stay short; it is cut into sequences whose lengths
are powers of two, which need no padding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm import word_tokens
from webloom.llm.copies import split_copies
from webloom.llm.runtime import checkpointed
from webloom.runtime import spread

WINDOW, END_ID, SHARD_BYTES = 2048, 1, 4 << 20
K1, B = 1.2, 0.75
#: Terms of a rest that weigh this share of its heaviest one can be its key; bits of a term in a key; steps of the salt.
HEAVY, TERM_BITS, SALTS = 0.7, 31, 1 << 20
ENCODED = "doc_id long, ids binary, size long, terms binary, times binary, n long"
SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padding long"
)


@dataclass(frozen=True)
class Stats:
    """The count of documents, the documents of each term, and the documents' mean length."""

    n: int
    df: np.ndarray
    mean: float

    def useful(self, term: np.ndarray) -> np.ndarray:
        """Whether each term is in more than one document and in half of them at most."""
        return (self.df[term] >= 2) & (2 * self.df[term] <= self.n)

    def weight(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The BM25 weight of terms that stand tf times in documents of a length."""
        idf = np.log((self.n - self.df[term] + 0.5) / (self.df[term] + 0.5))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(self.mean, 1)))


class Bm25:
    """An inverted index over token ids, with the weight of each posting worked out.

    A term in more than half of the documents has no positive weight in BM25 and one
    in a single document finds nothing, so neither is kept. ``stats`` are the count of
    all documents, their document frequencies and mean length, if docs are a part of them.
    """

    def __init__(self, docs: list[np.ndarray], stats: Stats | None = None) -> None:
        self.n = n = len(docs)
        lengths = np.array([len(d) for d in docs], np.int64)
        flat = np.concatenate(docs).astype(np.int64) if n else np.zeros(0, np.int64)
        key, tf = np.unique((np.repeat(np.arange(n), lengths) << 32) | flat, return_counts=True)
        doc, term = key >> 32, key & 0xFFFFFFFF
        here = np.bincount(term) if len(term) else np.zeros(1, np.int64)
        stats = stats or Stats(n, here, lengths.mean() if n else 0)
        keep = (here[term] >= 2) & stats.useful(term)
        doc, term, tf = doc[keep], term[keep], tf[keep]
        self.terms = np.split(term, np.searchsorted(doc, np.arange(1, n))) if n else []
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], stats.weight(term, tf, lengths[doc])[order]
        self.ends = np.searchsorted(term[order], np.arange(len(here) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """Every document's score for the terms of one."""
        terms = self.terms[seed]
        first = self.ends[terms]
        count = self.ends[terms + 1] - first
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.bincount(self.doc[at], self.weight[at], self.n)


def fill_windows(
    docs: list[np.ndarray], window: int = WINDOW, stats: Stats | None = None
) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold each id of docs once."""
    sequences, start, left = [], [], []
    for i, ids in enumerate(docs):
        whole = len(ids) // window
        sequences += [[(i, w * window, window)] for w in range(whole)]
        start.append(whole * window)
        left.append(len(ids) - whole * window)
    pool = np.flatnonzero(left)
    start, left = np.array(start, np.int64)[pool], np.array(left, np.int64)[pool]
    index = Bm25([docs[i][s:] for i, s in zip(pool, start, strict=True)], stats)
    unused = np.ones(len(pool), bool)
    for seed in np.argsort(-left, kind="stable"):
        if not unused[seed]:
            continue
        unused[seed] = False
        pieces, gap = [(pool[seed], start[seed], left[seed])], window - left[seed]
        if gap and unused.any():
            rest = np.flatnonzero(unused)
            ranked = rest[np.argsort(-index.scores(seed)[rest], kind="stable")]
            sizes, at = left[ranked], 0
            while gap and at < len(ranked):
                fits = sizes[at:] <= gap
                step = int(fits.argmax())
                if not fits[step]:
                    break
                one = ranked[at + step]
                pieces.append((pool[one], start[one], left[one]))
                unused[one] = False
                gap -= left[one]
                at += step + 1
            if gap and len(ranked := ranked[unused[ranked]]):
                one = ranked[0]
                pieces.append((pool[one], start[one], gap))
                start[one] += gap
                left[one] -= gap
                gap = 0
        sequences += [pieces] if not gap else powers_of_two(pieces, window - gap)
    return sequences


def powers_of_two(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """pieces of total ids as sequences with the lengths of total's binary digits."""
    sequences, pieces = [], [*pieces[::-1]]
    for bit in reversed(range(int(total).bit_length())):
        if total >> bit & 1:
            room, own = 1 << bit, []
            while room:
                doc, start, length = pieces.pop()
                own.append((doc, start, min(length, room)))
                if length > room:
                    pieces.append((doc, start + room, length - room))
                room -= own[-1][2]
            sequences.append(own)
    return sequences


def slices(batches: Iterator[pa.RecordBatch], most: int = SHARD_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches with a size column in slices of about most bytes, or one larger row, as a worker's memory is small."""
    for batch in batches:
        total = np.cumsum(batch.column("size").to_numpy())
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def encoded(docs: DataFrame, path: str, kind: str, window: int) -> DataFrame:
    """doc_id, ids (of numpy's kind, END_ID last), size in bytes of text, and terms, times and n of the rest.

    ``terms`` are the distinct ids of the rest and ``times`` how often they stand there, so
    that they are found once; ``n`` is the length of the rest.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_tokens.encoder(path), np.array([END_ID], kind)
        for batch in slices(batches):
            parts: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            texts = (x.as_py() for x in batch.column("text"))
            for at, pieces in word_tokens.batches(texts, split=encoder.known):
                for i, ids in zip(at, encoder.ids(pieces), strict=True):
                    parts[i].append(ids)
            ids = [np.concatenate([*p, end]).astype(kind) for p in parts]
            row, term, times, n = rest_terms([x[len(x) // window * window :] for x in ids])
            ends = np.searchsorted(row, np.arange(len(ids)), "right")
            columns = [
                pa.array([x.tobytes() for x in ids], pa.binary()),
                batch.column("size"),
                _binaries(term.astype(kind), ends),
                _binaries(times.astype("<u4"), ends),
                pa.array(n),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], [x.split()[0] for x in ENCODED.split(", ")])

    text = F.coalesce("text", F.lit(""))
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")))
    sized = rows.withColumn("size", (F.octet_length("text") + 64).cast("long"))
    return checkpointed(sized.mapInArrow(encode, ENCODED))


def _binaries(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of runs of flat, as binary values."""
    offsets = (np.concatenate([[0], ends]) * flat.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())])


def rest_terms(rests: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and its count for the distinct terms of each rest, and the lengths of the rests."""
    lengths = np.array([len(r) for r in rests], np.int64)
    flat = np.concatenate(rests).astype(np.int64) if rests else np.zeros(0, np.int64)
    cell, times = np.unique((np.repeat(np.arange(len(rests)), lengths) << 32) | flat, return_counts=True)
    return cell >> 32, cell & 0xFFFFFFFF, times, lengths


def _held_terms(batch: pa.RecordBatch, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """rest_terms of encoded rows."""
    terms, times = (batch.column(c).cast(pa.large_binary()) for c in ("terms", "times"))
    each = np.diff(np.frombuffer(times.buffers()[1], np.int64)[times.offset : times.offset + len(times) + 1]) // 4
    flat = [np.frombuffer(b"".join(c.to_pylist()), k).astype(np.int64) for c, k in ((terms, kind), (times, "<u4"))]
    return np.repeat(np.arange(len(each)), each), *flat, batch.column("n").to_numpy()


def rest_stats(rows: DataFrame, kind: str) -> Stats:
    """The statistics of all rests; the driver gets a row for each term of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(1, np.int64), 0, 0
        for batch in batches:
            _, term, _, lengths = _held_terms(batch, kind)
            more = np.bincount(term, minlength=len(df))
            more[: len(df)] += df
            df, n, total = more, n + int((lengths > 0).sum()), total + int(lengths.sum())
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-2, -1, *term.tolist()], pa.int64()), pa.array([total, n, *df[term].tolist()], pa.int64())],
            ["term", "n"],
        )

    counted = rows.select("terms", "times", "n").mapInArrow(count, "term long, n long")
    counts = {r.term: r.n for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    total, n = counts.pop(-2, 0), counts.pop(-1, 0)
    df = np.zeros(max(counts, default=0) + 1, np.int64)
    df[[*counts]] = [*counts.values()]
    return Stats(n, df, total / max(n, 1))


def lexical_keys(batch: pa.RecordBatch, stats: Stats, kind: str) -> np.ndarray:
    """A key for each encoded row: its first two heavy terms in a fixed order; 0 without a useful term.

    Two rests choose the same first term as likely as their heavy terms overlap, as the
    order of terms has nothing to do with their weights.
    """
    row, term, tf, lengths = _held_terms(batch, kind)
    keep = stats.useful(term)
    row, term, tf = row[keep], term[keep], tf[keep]
    weight, most = stats.weight(term, tf, lengths[row]), np.zeros(len(lengths))
    np.maximum.at(most, row, weight)
    heavy = weight >= HEAVY * most[row]
    row, code = row[heavy], (term[heavy] * 0x9E3779B1 & ((1 << TERM_BITS) - 1)) | 1 << TERM_BITS
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    begins = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    second = np.minimum(begins + 1, max(len(row) - 1, 0))
    keys = np.zeros(len(lengths), np.int64)
    low = np.where(row[second] == row[begins], code[second] & ((1 << TERM_BITS) - 1), 0)
    keys[row[begins]] = (code[begins] & ((1 << TERM_BITS) - 1)) << TERM_BITS | low
    return keys


def shard_places(sizes: DataFrame, shard_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, with the place in bytes from each on and the bytes over which its rows spread.

    ``sizes`` has key and bytes. Keys stand one after another. All keys of a first term
    that fill half a shard at most share a place; those of a larger term have their own,
    and a key of more than a shard spreads over its bytes. The driver gets a row for each
    first term and each shard.
    """
    top = F.shiftright("key", TERM_BITS)
    groups = checkpointed(sizes.groupBy("key").agg(F.sum("bytes").alias("bytes")))
    tops = sorted(map(tuple, groups.groupBy(top).agg(F.sum("bytes")).collect()))
    found, hot, start = [], [], 0
    for first, size in tops:
        if 2 * size <= shard_bytes:
            found.append((first << TERM_BITS, start + size // 2, 0))
        else:
            hot.append((first, start))
        start += size
    if hot:
        starts = groups.sparkSession.createDataFrame(hot, "top long, start long")
        before = Window.partitionBy("top").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        placed = (
            groups.withColumn("top", top)
            .join(starts, "top")
            .withColumn("start", F.col("start") + F.coalesce(F.sum("bytes").over(before), F.lit(0)))
        )
        large = F.col("bytes") > shard_bytes
        middle = F.floor((F.col("start") + F.col("bytes") / 2) / shard_bytes)
        found += map(tuple, placed.filter(large).select("key", "start", "bytes").collect())
        small = placed.filter(~large).groupBy("top", middle.alias("shard")).agg(F.min("key").alias("key"))
        found += [(r.key, r.shard * shard_bytes, 0) for r in small.collect()]
    return tuple(np.array(c, np.int64) for c in zip(*sorted(found), strict=True)) if found else (np.zeros(0, np.int64),) * 3


def pack_documents(
    docs: DataFrame, path: str, window: int = WINDOW, seed: int = 42, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset, padding: a row for each piece.

    ``ids`` are little-endian unsigned 32-bit token ids. Every document ends with one
    END_ID, which ``doc_tokens`` counts, so a null or empty text is a document of one
    id. Rows are documents: repeated rows are packed as often as they stand. ``padding``
    is what a sequence lacks to ``window``; a length that is a power of two lacks
    nothing. An empty table gives no rows; other columns are ignored. A shard holds
    about ``shard_bytes`` of text, twice that at most, or one longer document.
    """
    kind = "<u2" if word_tokens.encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
    rows = encoded(docs, path, kind, window)
    stats = rest_stats(rows, kind)
    split = split_copies(rows, F.col("size"), shard_bytes // 4)
    alone = split.rare.withColumns({"part": F.lit(0).cast("long"), "copies": F.lit(1).cast("long")})
    salt = F.pmod(F.xxhash64(F.lit(seed), "key", "part"), F.lit(SALTS)).alias("salt")
    units = alone.unionByName(split.portions).select("row.*", "copies", salt)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array(lexical_keys(batch, stats, kind))
            yield pa.RecordBatch.from_arrays([keys, batch.column("bytes")], ["key", "bytes"])

    weighed = units.select("terms", "times", "n", (F.col("size") * F.col("copies")).alias("bytes"))
    keys, first, spans = shard_places(weighed.mapInArrow(keyed, "key long, bytes long"), shard_bytes)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(keys, lexical_keys(batch, stats, kind), "right") - 1
            place = first[at] + spans[at] * batch.column("salt").to_numpy() // SALTS
            kept = ["doc_id", "ids", "copies"]
            yield pa.RecordBatch.from_arrays([pa.array(place // shard_bytes), *batch.select(kept).columns], ["shard", *kept])

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        table = table.take(np.repeat(np.arange(table.num_rows), table.column("copies").to_numpy()))
        doc_ids = table.column("doc_id").to_pylist()
        ids = [np.frombuffer(x.as_buffer(), kind).astype("<u4") for x in table.column("ids")]
        out: list[tuple] = []
        for number, pieces in enumerate(fill_windows(ids, window, stats)):
            offset, total = 0, int(sum(p[2] for p in pieces))
            padding = 0 if total & (total - 1) == 0 else window - total
            for doc, start, length in pieces:
                own = ids[doc][start : start + length].tobytes()
                sequence = (key[0].as_py() << 32) + number
                out.append((doc_ids[doc], int(start), int(length), own, len(ids[doc]), sequence, offset, padding))
                offset += int(length)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.binary() if n == "ids" else pa.int64() for n in names]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    placed = units.drop("size").mapInArrow(dealt, "shard long, doc_id long, ids binary, copies long")
    return placed.groupBy("shard").applyInArrow(pack, SCHEMA)
