"""Mixing, formatting, sharding, token counts and packing."""

from __future__ import annotations

import hashlib
import json
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from webloom.llm import chat_format, copies, mixing, packing, queries, sharding, token_counts, word_tokens

DOCS = "doc_id long, text string, source string, lang string, n_chars long"
PATH = token_counts.tokenizer_path()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def documents(spark):
    rng = np.random.default_rng(5)
    words = ["thanea", "Éréa", "über", "in", "the,", "of.", "x1", "it's", "<|endoftext|>"]
    rows = []
    for i in range(300):
        text = " ".join(rng.choice(words, rng.integers(1, 120)))
        rows.append((i, text, None if i % 10 == 9 else f"s{min(i % 10, 4)}", "en", len(text)))
    rows += [(400, None, "s1", None, None), (401, "", "s1", None, 0), (402, "word " * 9000, "s2", "en", 45000), (None, "a b", "s0", None, 3)]
    rows += [rows[0], rows[0]]
    return rows, spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS shard", "2 AS size", "3 AS taken", "4 AS row", "'s' AS slot")


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets():
    assert mixing.share_targets([10, 10, 100], [1, 2, 3]) == [22.5, 30.0, 67.5]
    assert mixing.share_targets([], []) == []
    assert mixing.share_targets([0, 5], [1, 2]) == [0.0, 5.0]


def test_sainte_lague_equals_the_highest_quotients():
    rng = np.random.default_rng(6)
    for _ in range(50):
        weights = rng.integers(1, 1000, rng.integers(1, 12)).astype(float)
        blocks = int(rng.integers(0, 300))
        most = rng.integers(0, 120, len(weights))
        want = np.zeros(len(weights), int)
        for _ in range(min(blocks, int(most.sum()))):
            want[np.argmax(np.where(want < most, weights / (2 * want + 1), -1))] += 1
        assert (mixing.sainte_lague(weights, most, blocks) == want).all()


def test_mix(documents):
    rows, df = documents
    found = mixing.mix_sources(df).collect()
    assert len(found) == len(rows)
    sizes, taken, targets = Counter(), Counter(), {}
    for r in found:
        assert 0 <= r.taken <= 3 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        targets[r.source] = r.target
        assert r.taken == r.passes * r["size"] + r.cut_words and r.cut_words <= r["size"]
    order = [*sorted(s for s in sizes if s is not None), None]
    want = mixing.share_targets([sizes[s] for s in order], [1, 2, 3] * 2)
    for source, target in zip(order, want, strict=True):
        assert targets[source] == pytest.approx(target) and abs(taken[source] - target) <= mixing.BLOCK_WORDS
    assert {(r.doc_id, r.taken) for r in found} == {(r.doc_id, r.taken) for r in mixing.mix_sources(df.repartition(3)).collect()}


def test_mixed_documents(documents):
    rows, df = documents
    mix = mixing.mixed_documents(df)
    assert mix.columns == df.columns
    want = Counter()
    for r in mixing.mix_sources(df).collect():
        want[r.doc_id] += r.taken
    got = Counter()
    for r in mix.collect():
        got[r.doc_id] += n_words(r.text)
        assert r.n_chars == len(r.text)
    assert got == +want


def test_mix_of_one_row_that_stands_very_often(spark, monkeypatch):
    """Equal rows are split over shards; slim units and whole rows are mixed alike."""
    monkeypatch.setattr(mixing, "SHARD_ROWS", 50)
    monkeypatch.setattr(mixing, "GROUPS", 4)
    rows = [(7, "a b c d e", "s1")] * 1000 + [(i, "w " * (i % 9), f"s{i % 2}") for i in range(1000)] + [(None, "x y z", None)] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    dealt, sources, plan = mixing._planned(df, 42, 16)
    held = dealt.groupBy("number", "group", "shard").agg(F.sum("copies").alias("n")).agg(F.max("n"), F.count("*")).first()
    assert held[0] < 200 and held[1] > 30
    found = mixing.mix_sources(df).collect()
    assert len(found) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in found)
    taken, size, target = Counter(), Counter(), {}
    for r in found:
        taken[r.source] += r.taken
        size[r.source] += r["size"]
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 16 for s in target) and [target[s] for s in ("s0", "s1", None)] == mixing.share_targets([size[s] for s in ("s0", "s1", None)], [1, 2, 3])
    want = Counter(map(str, map(tuple, found)))
    assert want == Counter(map(str, map(tuple, mixing.mix_sources(df.repartition(7)).collect())))
    got = Counter()
    for r in mixing.mixed_documents(df).collect():
        got[r.doc_id] += n_words(r.text)
    every = Counter()
    for r in found:
        every[r.doc_id] += r.taken
    assert got == +every


def test_mix_empty(documents):
    assert mixing.mix_sources(documents[1].filter("false")).collect() == []


CHATS = [
    (1, 2, "assistant", "fine <|im_end|> <\\| <\\\\|x <|"),
    (1, 1, "user", "a<"),
    (1, 3, "assistant", "|more"),
    (1, 4, "user", None),
    (2, 1, "odd\nrole\\n<|im_start|>", "tail<"),
    (2, 1, "odd\nrole\\n<|im_start|>", "tail<"),
    (3, None, None, ""),
    (None, 1, "assistant", "x" * 50_000),
    (4, 1, "system", "only"),
]


def test_chats_round_trip(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS mask", "2 AS formatted")
    chats = chat_format.format_chats(df).withColumns(
        {"turns": chat_format.read_turns(F.col("formatted")), "loss": chat_format.read_loss_text(F.col("formatted"), F.col("mask"))}
    )
    found = {r.conv_id: r for r in chats.collect()}
    by = defaultdict(list)
    for conv, turn, role, text in CHATS:
        by[conv].append((turn if turn is not None else -1, role or "", text or ""))
    for conv, turns in by.items():
        r = found[conv]
        want = [t[1:] for t in sorted(turns)]
        assert [tuple(t) for t in r.turns] == want
        assert r.loss == "".join(text for role, text in want if role == "assistant")
        assert sum(m.chars for m in r.mask) == len(r.formatted)
        assert r.formatted.count("<|im_start|>") == len([1 for i, t in enumerate(want) if not i or want[i - 1][0] != t[0]])
    assert found[1].formatted.count("<|im_sep|>") == 1
    assert chat_format.format_chats(df.filter("false")).collect() == []


@pytest.mark.parametrize("alternate", [True, False])
def test_chats_of_many_turns(spark, alternate):
    """20,000 turns take time in proportion to their number."""
    n = 20_000
    df = spark.range(n).select(
        F.lit(1).alias("conv_id"),
        F.col("id").alias("turn"),
        F.when((F.col("id") % 2 == 0) & F.lit(alternate), "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("text <|im_end|> "), F.col("id")).alias("text"),
    )
    began = time.monotonic()
    r = chat_format.format_chats(df).select(
        F.size(chat_format.read_turns(F.col("formatted"))).alias("n"),
        chat_format.read_loss_text(F.col("formatted"), F.col("mask")).alias("loss"),
        F.aggregate("mask", F.lit(0), lambda total, run: total + run["chars"]).alias("chars"),
        F.char_length("formatted").alias("length"),
    ).first()
    assert time.monotonic() - began < 15
    assert r.n == n and r.chars == r.length
    assert r.loss == "".join(f"text <|im_end|> {i}" for i in range(n) if i % 2 or not alternate)


def test_a_mask_of_another_string_is_an_error(spark):
    df = spark.createDataFrame(CHATS[:4], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="not that of the string"):
        chat_format.format_chats(df).select(chat_format.read_loss_text(F.concat(F.lit("<|im_start|>x\nq<|im_sep|>"), "formatted"), F.col("mask"))).collect()


def test_shards(documents):
    rows, df = documents
    found = sharding.shard_records(df, 8, bucket_bytes=5_000).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter(r[:2] for r in rows)
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = sharding.shard_records(df, 8, bucket_bytes=5_000).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))
    order = [r.doc_id for r in sorted(found, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.3


def test_shards_of_one_row_that_stands_very_often(spark):
    """100,000 equal rows are split over the buckets, in the same numbers in each run."""
    hot = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x" * 40).alias("text"))
    rest = spark.range(100, 20_100).select(F.col("id").alias("doc_id"), F.lit("y" * 40).alias("text"))
    df = hot.unionByName(rest)
    split = copies.split_copies(df, F.lit(41), 20_000)
    portions = split.portions.select("copies").collect()
    assert sum(r.copies for r in portions) == 100_000 and max(r.copies for r in portions) <= 20_000 // 41
    assert split.rare.count() == 20_000
    found = sharding.shard_records(df, 8, bucket_bytes=160_000)
    sizes = {r.shard: (r.n, r.hot, r.slots) for r in found.groupBy("shard").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") == 7).alias("hot"), F.countDistinct("slot").alias("slots")).collect()}
    assert [sizes[i][0] for i in range(8)] == [15_000] * 8 == [sizes[i][2] for i in range(8)]
    assert all(10_000 < hot < 14_500 for _, hot, _ in sizes.values())
    again = sharding.shard_records(df.repartition(3), 8, bucket_bytes=160_000)
    assert found.exceptAll(again).isEmpty()


def test_buckets_of_shards_are_partitions(spark, documents):
    plan = sharding.shard_records(documents[1], 8, bucket_bytes=5_000)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_shards_of_few_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted((r.shard, r.slot) for r in sharding.shard_records(df, 8).collect()) == [(0, 0), (1, 0), (2, 0)]
    assert sharding.shard_records(df.filter("false"), 8).collect() == []


def test_written_shards(spark, documents, tmp_path):
    sharding.write_shards(documents[1], str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 4


TEXTS = ["", "  ", "It's don't we'll <|endoftext|> a<|startoftext|>b ... foo.bar, \x1c z \xa0 é İstanbul ΣΑΣ ﬁ 漢字 1234 ½ 가 😀 ́abc", "A.,b", "z" * 5000]


def test_word_ids_are_the_librarys(tokenizer, monkeypatch):
    rng = np.random.default_rng(7)
    texts = TEXTS + ["".join(rng.choice(list("abcÀéß .,'\n\t<|>Σİ1½́漢sdtlm"), 150)) for _ in range(200)]
    encoder = word_tokens.WordEncoder(PATH)
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [list(x) for x in encoder.ids(texts)] == want
    monkeypatch.setattr(word_tokens, "MOST_WORDS", 20)
    assert [list(x) for x in encoder.ids(texts)] == want
    assert list(encoder.counts(texts)) == [len(w) for w in want]


def test_long_texts_are_cut_at_white_space_only():
    text = " ".join(["word"] * 50) + "x" * 300 + "\nend"
    parts = list(word_tokens.pieces(text, 40))
    assert "".join(parts) .replace(" ", "") == text.replace(" ", "") and max(map(len, parts[:-3])) < 60
    assert list(word_tokens.pieces("x" * 100, 10)) == ["x" * 100]


def test_token_counts(documents, tokenizer, monkeypatch):
    rows, df = documents
    found = Counter(map(tuple, token_counts.token_counts(df, PATH).collect()))
    want = Counter()
    for doc_id, text, *_ in rows:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        want[(doc_id, len((text or "").encode()), n, n > 2048)] += 1
    assert found == want
    assert token_counts.token_counts(df.filter("false"), PATH).collect() == []


def check_packing(rows, found, tokenizer, window=2048):
    ids = {}
    for doc_id, text, *_ in rows:
        ids[doc_id] = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
    covered, sequences = Counter(), defaultdict(list)
    for r in found:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert bytes(r.ids) == own.tobytes() and len(own) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        covered.update((r.doc_id, i) for i in range(r.start, r.start + r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    copies = Counter(r[0] for r in rows)
    assert covered == Counter({(d, i): n for d, n in copies.items() for i in range(len(ids[d]))})
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return sum(window - t for p in sequences.values() if (t := sum(x[1] for x in p)) & (t - 1))


def test_packing(documents, tokenizer):
    rows, df = documents
    for shard_bytes in (4 << 20, 20_000):
        assert check_packing(rows, packing.pack_documents(df, PATH, shard_bytes=shard_bytes).collect(), tokenizer) == 0
    assert packing.pack_documents(df.filter("false"), PATH).collect() == []


def test_packing_of_one_document_that_stands_very_often(spark, tokenizer, monkeypatch):
    """100,000 equal rows are packed in many shards, each of bounded size."""
    hot = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("thanea in the über").alias("text"))
    rest = spark.range(100, 300).select(F.col("id").alias("doc_id"), F.concat(F.lit("tail of "), F.col("id").cast("string")).alias("text"))
    found = packing.pack_documents(hot.unionByName(rest), PATH, shard_bytes=500_000)
    n = len(tokenizer.encode("thanea in the über", add_special_tokens=False).ids) + 1
    by = found.groupBy(F.shiftright("sequence_id", 32)).agg(F.sum("length").alias("ids")).collect()
    assert len(by) > 10 and max(r.ids for r in by) < n * 2 * 500_000 / 80
    held = found.filter("doc_id = 7").groupBy("start", "length").count().collect()
    covered = Counter()
    for r in held:
        for i in range(r.start, r.start + r.length):
            covered[i] += r["count"]
    assert covered == {i: 100_000 for i in range(n)}


def test_files_with_other_rules_are_encoded_by_the_library(spark, tokenizer, tmp_path):
    rules = json.loads(open(PATH, encoding="utf-8").read())
    rules["pre_tokenizer"]["pretokenizers"][0]["behavior"] = "Isolated"
    rules["pre_tokenizer"]["pretokenizers"][0]["invert"] = False
    other = str(tmp_path / "other.json")
    with open(other, "w", encoding="utf-8") as f:
        json.dump(rules, f)
    library, texts = Tokenizer.from_file(other), ["a b, c1", "", "it's <|endoftext|> x"]
    encoder = word_tokens.WordEncoder(other)
    assert not encoder.known and word_tokens.WordEncoder(PATH).known
    assert [list(x) for x in encoder.ids(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    found = token_counts.token_counts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), other)
    assert [r.n_tokens for r in sorted(found.collect())] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_bm25_equals_its_formula():
    docs = [np.array(x) for x in ([1, 2, 2, 3], [2, 4], [5, 5, 1], [6, 7, 8, 9], [6, 2], [10, 11, 12])]
    index = packing.Bm25(docs)
    mean = np.mean([len(d) for d in docs])
    for seed in range(len(docs)):
        want = np.zeros(len(docs))
        for term in np.unique(docs[seed]):
            df = sum(term in d for d in docs)
            if df < 2 or 2 * df > len(docs):
                continue
            for i, d in enumerate(docs):
                tf = (d == term).sum()
                want[i] += np.log((len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        assert np.allclose(index.scores(seed), want)


def test_neighbours_share_windows():
    rng = np.random.default_rng(8)
    topics = [rng.choice(1000, 30) + 1000 * k for k in range(40)]
    docs = [rng.choice(t, 500) for t in topics for _ in range(4)]
    together = sum(len({d // 4 for d, _, _ in pieces}) == 1 for pieces in packing.fill_windows(docs, 2000))
    assert together == 40


def test_planted_topics_share_windows_over_many_shards(spark):
    rng = np.random.default_rng(9)
    words = rng.permutation([a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("land", "ton", "ville", "berg", "stone", "ford")])
    topics = [rng.choice(words, 12, replace=False) for _ in range(60)]
    rows = [(k * 4 + i, " ".join(rng.choice(topics[k], 150))) for k in range(60) for i in range(4)]
    found = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH, shard_bytes=8_000).collect()
    assert len({r.sequence_id >> 32 for r in found}) > 20
    windows = defaultdict(set)
    for r in found:
        windows[r.sequence_id].add(r.doc_id)
    together = [a // 4 == b // 4 for w in windows.values() for a in w for b in w if a < b]
    assert np.mean(together) > 0.3  # by chance 3 in 239


def test_slices_hold_each_row_once_and_are_bounded():
    import pyarrow as pa

    sizes = [5, 5, 1, 30, 2, 9, 10, 1]
    found = [b.column("size").to_pylist() for b in packing.slices(iter([pa.record_batch({"size": sizes})]), 10)]
    assert sum(found, []) == sizes and found == [[5, 5], [1], [30], [2], [9], [10], [1]]


def test_places_of_keys_bound_a_shard(spark):
    key = lambda a, b: (a << packing.TERM_BITS) + b
    sizes = [(key(a, b), 10) for a in range(50) for b in range(3)] + [(key(60, b), 7) for b in range(100)] + [(key(70, 1), 950), (key(70, 2), 5)]
    keys, first, spans = packing.shard_places(spark.createDataFrame(sizes, "key long, bytes long"), 100)
    held = Counter()
    for k, size in sizes:
        at = np.searchsorted(keys, k, "right") - 1
        for i in range(size):
            held[int(first[at] + spans[at] * i // size) // 100] += 1
    assert sum(held.values()) == sum(s for _, s in sizes) and max(held.values()) <= 150 and len(held) >= 30
    assert all(len({np.searchsorted(keys, key(a, b), "right") for b in range(3)}) == 1 for a in range(50))


def test_powers_of_two():
    out = packing.powers_of_two([(0, 5, 700), (1, 0, 300)], 1000)
    assert [sum(p[2] for p in s) for s in out] == [512, 256, 128, 64, 32, 8]


def test_op5_digest_is_sha256(spark):
    assert spark.sql("SELECT sha2('a\nb\n', 256)").first()[0] == hashlib.sha256(b"a\nb\n").hexdigest()
    assert spark.sql("SELECT crc32('é')").first()[0] == zlib.crc32("é".encode())


def water_level(sizes, weights):
    """Targets of a third way: the level at which min(3 size, level x weight) sums to all sizes."""
    low, high = 0.0, 3.0 * sum(sizes) + 1
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * s, level * w) for s, w in zip(sizes, weights, strict=True)) < sum(sizes) else (low, level)
    return [min(3 * s, high * w) for s, w in zip(sizes, weights, strict=True)]


def test_mixing_query_against_plain_figures(spark, sf_dir):
    docs = queries.read_table(spark, sf_dir, "documents").select("doc_id", "text", "source").collect()
    found = {r.doc_id: r for r in queries.op4_sainte_lague_mix(spark, sf_dir).collect()}
    assert len(found) == len(docs)
    sizes = Counter()
    for d in docs:
        sizes[d.source] += n_words(d.text)
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    targets = dict(zip(order, water_level([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))]), strict=True))
    taken = Counter()
    for d in docs:
        r = found[d.doc_id]
        assert (r["size"], r.source_size) == (n_words(d.text), sizes[d.source]) and r.target == pytest.approx(targets[d.source], rel=1e-9)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[d.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= max(0.01 * targets[s], 16) for s in order)


def test_sharding_query_against_plain_figures(spark, sf_dir):
    docs = {r.doc_id: r.text for r in queries.read_table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    found = queries.op7_two_pass_shards(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in found) == Counter(docs.keys()) and {(r.law, r.grown_shard) for r in found} == {("rows", None)}
    slots = defaultdict(list)
    for r in found:
        data = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
