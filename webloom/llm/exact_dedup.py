"""Exact duplicates of whole texts, owned by the terminal nodes of Patricia tries.

Texts are equal if they are after each run of white space became one space. A first pass
inserts every text of a task into tries of bounded size, so a text leaves its task once
for each of these chunks, with its smallest doc_id and its count. These representatives
are dealt by length and content hash, and a task inserts their full byte strings into one
compressed radix trie, whose terminal nodes hold the smallest identifier, the count and
the chunks that a text came from.

A trie that outgrows its bound gives up its heaviest subtrees: their terminals, and all
texts that still come for them, go to the next round, which deals them anew. So do the
terminals of a text that so many chunks have that its representatives were dealt to
several tasks. Rounds end when nothing is left over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.runtime import written

WHITE = r"[\x20\x09-\x0D]+"
#: Bytes that a trie holds at most, bytes that a node and a row cost beside their strings, and representatives
#: of one text that one task aims at.
HELD, NODE_BYTES, FAN = 128 << 20, 400, 32
#: Rows of a batch that a task returns.
OUT_ROWS = 4096

ROW = pa.schema([("doc_id", pa.int64()), ("chunk", pa.int64()), ("place", pa.int64()), ("least", pa.bool_()), ("sha256", pa.string()),
                 ("hash", pa.int64()), ("length", pa.int64()), ("text", pa.binary()), ("id", pa.int64()), ("rows", pa.int64())])
LINK = pa.schema([("chunk", pa.int64()), ("place", pa.int64()), ("to_chunk", pa.int64()), ("to_place", pa.int64()), ("hash", pa.int64()), ("length", pa.int64()),
                  ("text", pa.binary()), ("id", pa.int64()), ("rows", pa.int64()), ("own_chunk", pa.int64()), ("own_place", pa.int64())])
KINDS = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string", pa.binary(): "binary"}


class Node:
    """A node and the edge that leads to it; ``rows`` is 0 unless a text ends here."""

    __slots__ = ("label", "children", "rows", "first", "own", "members", "salted")

    def __init__(self, label: bytes) -> None:
        self.label, self.children = label, {}
        self.rows, self.first, self.own, self.members, self.salted = 0, None, None, [], False

    def add(self, first: tuple, rows: int, own) -> None:
        """More rows of the text, of which ``first`` (no id, id, ...) is the least; ``own`` says where that one is."""
        if not self.rows or (first, own) < (self.first, self.own):
            self.first, self.own = first, own
        self.rows += rows


def _common(key: bytes, at: int, label: bytes) -> int:
    """How many bytes key, from a place on, and a label share."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if key[at + low : at + mid] == label[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Patricia:
    """A compressed radix trie of byte strings; ``held`` counts the bytes of its labels and nodes."""

    def __init__(self) -> None:
        self.root, self.held = Node(b""), 0

    def insert(self, key: bytes) -> Node:
        """The terminal node of key, new if its ``rows`` is 0."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.held += len(child.label) + NODE_BYTES
                return child
            if not key.startswith(child.label, at):
                shared = _common(key, at, child.label)
                upper = Node(child.label[:shared])
                child.label = child.label[shared:]
                upper.children[child.label[0]] = child
                node.children[key[at]] = upper
                self.held += NODE_BYTES
                child = upper
            node, at = child, at + len(child.label)
        return node

    def take(self, byte: int) -> Iterator[tuple[bytes, Node]]:
        """Terminals below one child of the root, with their strings; they leave the trie."""
        todo = [(b"", self.root.children.pop(byte))]
        while todo:
            above, node = todo.pop()
            self.held -= len(node.label) + NODE_BYTES
            key = above + node.label
            todo += [(key, child) for child in node.children.values()]
            if node.rows:
                yield key, node

    def terminals(self) -> Iterator[tuple[bytes, Node]]:
        """All terminals; the trie is empty afterwards."""
        if self.root.rows:
            yield b"", self.root
        for byte in list(self.root.children):
            yield from self.take(byte)
        self.root, self.held = Node(b""), 0

    def heaviest(self) -> list[int]:
        """The children of the root, that whose subtree holds most bytes first."""
        return sorted(self.root.children, key=lambda byte: (-self._weight(self.root.children[byte]), byte))

    @staticmethod
    def _weight(node: Node) -> int:
        total, todo = 0, [node]
        while todo:
            one = todo.pop()
            total += len(one.label) + NODE_BYTES
            todo += one.children.values()
        return total


def _key(number: int, text: bytes) -> bytes:
    """The content hash and the text. Hashes are spread evenly, so no trie is deeper than log n above the texts."""
    return (number & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "big") + text


def _schema(fields: pa.Schema) -> str:
    return ", ".join(f"{f.name} {KINDS[f.type]}" for f in fields)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded rows and bytes."""
    held, size, text = [], 0, schema.get_field_index("text")
    for row in rows:
        held.append(row)
        size += len(row[text] or b"")
        if len(held) >= OUT_ROWS or size > most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _chunks(texts: DataFrame, most: int) -> DataFrame:
    """ROW rows of (doc_id, text, hash, sha256), one a document.

    ``place`` numbers the texts of a chunk. The first row of each has the text, the smallest id
    and the count of its rows; ``least`` marks one row of the smallest id.
    """

    def insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        trie, rows = Patricia(), []

        def told() -> Iterator[tuple]:
            order = {id(node): place for place, node in enumerate(dict.fromkeys(r[1] for r in rows))}
            keys = {id(node): key for key, node in trie.terminals()}
            for at, (doc_id, node, hash_, sha) in enumerate(rows):
                whole = keys.pop(id(node), None)
                more = (hash_, len(whole) - 8, whole[8:], node.first[1], node.rows) if whole is not None else (None,) * 5
                yield doc_id, number, order[id(node)], at == node.own, sha, *more

        for batch in batches:
            for doc_id, text, hash_, sha in zip(*(c for c in batch.columns), strict=True):
                one, hash_ = doc_id.as_py(), hash_.as_py()
                node = trie.insert(_key(hash_, text.as_py()))
                node.add((one is None, one), 1, len(rows))
                rows.append((one, node, hash_, sha.as_py()))
                if trie.held + NODE_BYTES * len(rows) > most:
                    yield from _batches(told(), ROW)
                    trie, rows, number = Patricia(), [], number + 1
        yield from _batches(told(), ROW)

    return texts.mapInArrow(insert, _schema(ROW))


def _owners(dealt: DataFrame, most: int) -> DataFrame:
    """LINK rows of representatives, which say where their smallest doc_id is and whether their text is salted.

    A text that is settled gives each of its members id, rows and owner. Of one that isn't,
    members are linked to a representative, which also gets a row with the text. That is so
    for salted texts and for those of subtrees that the trie gave up.
    """

    def insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, gone = Patricia(), set()

        def settled(node: Node) -> Iterator[tuple]:
            for chunk, place in node.members:
                yield chunk, place, *(None,) * 5, node.first[1], node.rows, *node.own

        def carried(key: bytes, node: Node) -> Iterator[tuple]:
            at = node.members[0]
            for member in node.members:
                yield *member, *at, *(None,) * 7
            hash_ = int.from_bytes(key[:8], "big", signed=True)
            yield *at, None, None, hash_, len(key) - 8, key[8:], node.first[1], node.rows, *node.own

        def told() -> Iterator[tuple]:
            for batch in batches:
                columns = [batch.column(c) for c in ("chunk", "place", "hash", "text", "id", "rows", "own_chunk", "own_place", "salted")]
                for row in zip(*columns, strict=True):
                    chunk, place, hash_, text, one, rows, *own, salted = (x.as_py() for x in row)
                    key = _key(hash_, text)
                    node = Node(key) if key[0] in gone else trie.insert(key)
                    node.add((one is None, one), rows, tuple(own))
                    node.members.append((chunk, place))
                    node.salted |= salted
                    if key[0] in gone:
                        yield from carried(key, node)
                    elif trie.held > most:
                        for byte in trie.heaviest()[:-1]:
                            if trie.held > most // 2:
                                gone.add(byte)
                                for key_, node_ in trie.take(byte):
                                    yield from carried(key_, node_)
            for key, node in trie.terminals():
                yield from carried(key, node) if node.salted else settled(node)

        yield from _batches(told(), LINK)

    return dealt.mapInArrow(insert, _schema(LINK))


def _settle(reps: DataFrame, most: int, fan: int, number: int = 0) -> DataFrame:
    """(chunk, place, id, rows, own_chunk, own_place) for every representative."""
    heavy = written(reps.groupBy("hash", "length").agg(F.count("*").alias("n")).filter(F.col("n") > fan))
    dealt = reps.join(heavy, ["hash", "length"], "left").withColumn("salted", F.col("n").isNotNull())
    salt = F.pmod(F.xxhash64("chunk", F.lit(number)), F.ceil(F.col("n") / fan))
    deal = F.xxhash64("length", "hash", F.coalesce(salt, F.lit(0)), F.lit(number)).alias("deal")
    dealt = dealt.select("*", deal)
    size = reps.agg(F.sum(F.col("length") + NODE_BYTES)).first()[0] or 0
    parts = -(-size * 3 // (2 * most))
    usual = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "deal") if parts > usual else dealt.repartition("deal")
    found = written(_owners(dealt, most))
    answers = found.filter("to_chunk IS NULL AND text IS NULL").select("chunk", "place", "id", "rows", "own_chunk", "own_place")
    left = found.filter("text IS NOT NULL").select("chunk", "place", "hash", "length", "text", "id", "rows", "own_chunk", "own_place")
    if left.isEmpty():
        return answers
    after = _settle(left, most, fan, number + 1).withColumnsRenamed({"chunk": "to_chunk", "place": "to_place"})
    links = found.filter("to_chunk IS NOT NULL").select("chunk", "place", "to_chunk", "to_place")
    return answers.unionByName(links.join(after, ["to_chunk", "to_place"]).select(*answers.columns))


def normalised(text: Column) -> Column:
    """text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, " ")


def exact_groups(docs: DataFrame, most: int = HELD, fan: int = FAN) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text).

    Rows are one group if their texts are the same bytes once each run of white space is one
    space; null counts as empty. ``keep_id`` is the group's smallest doc_id and ``kept`` marks
    one row that has it, also where rows repeat. A null doc_id comes after all others, so it is
    kept only in a group without any. ``text_sha256`` is that of the normalised text. An
    empty table gives no rows; other columns are ignored, whatever their names.

    ``most`` bounds the bytes that a trie holds, and there are about (bytes of all texts / most)
    partitions or those that the session asks for, if they are more; a cluster for 100 TB
    should take 1 GB. A single text is held whole.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text"))
    texts = plain.select("doc_id", F.col("text").cast("binary"), F.xxhash64("text").alias("hash"), F.sha2("text", 256).alias("sha256"))
    rows = written(_chunks(texts, most))
    reps = rows.filter("rows IS NOT NULL").select(
        "chunk", "place", "hash", "length", "text", "id", "rows", F.col("chunk").alias("own_chunk"), F.col("place").alias("own_place")
    )
    found = rows.select("doc_id", "chunk", "place", "least", "sha256").join(_settle(reps, most, fan), ["chunk", "place"])
    own = (F.col("chunk") == F.col("own_chunk")) & (F.col("place") == F.col("own_place"))
    return found.select(
        "doc_id",
        F.col("id").alias("keep_id"),
        F.col("rows").alias("group_size"),
        (F.col("least") & own).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact deduplication keeps, with all their columns.

    A row is carried as one struct, so columns of any name and kind stay as they are.
    """
    held = written(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("at")))
    texts = held.select(F.col("at").alias("doc_id"), F.col("row")["text"].alias("text"))
    groups = exact_groups(texts).select(F.col("doc_id").alias("at"), "keep_id")
    own = F.col("row")["doc_id"].cast("long")
    named = groups.join(held.select("at", own.isNull().alias("none"), own.alias("own")), "at")
    # Within a group rows are ordered by id, nulls last; of equal ids one row stays.
    first = named.groupBy("keep_id").agg(F.min(F.struct("none", "own", "at")).alias("first")).select(F.col("first.at").alias("at"))
    return held.join(first, "at", "left_semi").select("row.*")
