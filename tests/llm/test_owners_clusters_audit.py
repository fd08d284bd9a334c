"""Exact dedup, ball-tree clusters and the filter audit against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from webloom.llm import ball_clusters, exact_dedup, filter_audit

DOCS = "doc_id long, text string, lang string, chunk string, hash double, rows long, part string, mask string, at long"


@pytest.fixture(scope="module")
def documents(spark):
    rng = np.random.default_rng(1)
    words = ["the", "of", "É", "A", "BC", "x$", "a%", "no", "thanea"]
    rows = []
    for i in range(400):
        # A third of all rows share one text; many others are short, so that they repeat.
        n = int(rng.integers(1, 4)) if i % 2 else int(rng.integers(95, 140))
        text = "hot copy " * 60 if i % 3 == 0 else " ".join(rng.choice(words, n))
        rows.append((i, text.replace(" ", "\t \n") if i % 7 == 0 else text, ["en", "de", None, ""][i % 4]))
    rows += [(500, None, "en"), (501, "", None), (502, " ", "en"), (503, "word" * 50_000, "de"), (None, "no", "en"), (None, "alone", "de"), (None, "alone", "de")]
    rows += [rows[0], rows[0], rows[401], (3, "other text", "en"), (504, "a\x00b\x1cc", "en"), (505, "a b", "en"), (506, "a b", "en")]
    order = rng.permutation(len(rows))
    rows = [rows[i] for i in order]
    return rows, spark.createDataFrame([(*r, "c", 0.5, 7, "p", "m", -1) for r in rows], DOCS)


def plain_groups(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda x: (x is None, x or 0))
        out += [(one, ids[0], len(ids), at == 0, hashlib.sha256(text.encode()).hexdigest()) for at, one in enumerate(ids)]
    return Counter(out)


@pytest.mark.parametrize(("most", "fan", "parts"), [(1 << 24, 32, 2), (9000, 32, 3), (60_000, 2, 7)])
def test_groups_equal_those_of_a_dictionary(documents, most, fan, parts):
    """Also where subtrees are given up and where a text is dealt to several tasks."""
    rows, df = documents
    found = exact_dedup.exact_groups(df.repartition(parts), most, fan)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, found.collect())) == plain_groups(rows)


def test_heavy_subtrees_are_given_up(spark):
    texts = [(i, f"{i % 150} " * 20) for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("doc_id", "CAST(text AS BINARY) AS text", "xxhash64(text) AS hash", "sha2(text, 256) AS sha256")
    rows = exact_dedup._chunks(df.coalesce(1), 9000)
    reps = rows.filter("rows IS NOT NULL").selectExpr("*", "chunk AS own_chunk", "place AS own_place", "false AS salted")
    found = exact_dedup._owners(reps.coalesce(1), 20_000).toPandas()
    carried, settled = found[found.text.notna()], found[found.text.isna() & found.to_chunk.isna()]
    assert rows.select("chunk").distinct().count() > 3 and len(carried) and len(settled)
    assert len(carried) + settled[["id"]].drop_duplicates().shape[0] >= 150 and carried["rows"].sum() + settled.groupby("id")["rows"].first().sum() == 300


def test_groups_of_an_empty_table(documents):
    assert exact_dedup.exact_groups(documents[1].filter("false")).count() == 0


def test_the_first_rows_stay_as_they_are(documents):
    rows, df = documents
    found = exact_dedup.keep_first(df)
    assert found.columns == df.columns and {tuple(r[3:]) for r in found.collect()} == {("c", 0.5, 7, "p", "m", -1)}
    want = Counter(one for one, _, _, kept, _ in plain_groups(rows).elements() if kept)
    assert Counter(r.doc_id for r in found.collect()) == want


def test_trie_holds_strings_that_share_beginnings():
    rng = np.random.default_rng(2)
    strings = {bytes(rng.choice([97, 98], rng.integers(0, 12)).astype(np.uint8)) for _ in range(500)} | {b"a" * n for n in range(300)}
    trie = exact_dedup.Patricia()
    for s in [*strings, *list(strings)[:50]]:
        trie.insert(s).add((False, len(s)), 1, (0, 0))
    assert trie.held <= sum(len(s) + 2 * exact_dedup.NODE_BYTES for s in strings)
    counts = {key: node.rows for key, node in trie.terminals()}
    assert set(counts) == strings and sum(counts.values()) == len(strings) + 50 and trie.held == 0


def plain_clusters(rows, n, rounds):
    kept = [(i, [int(np.floor(256 * float(v))) for v in x]) for i, x in rows if x is not None and len(x) == 64 and all(v is not None and np.isfinite(v) for v in x)]
    by_hash = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(x) for _, x in by_hash[:n]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, x in kept:
            own[nearest(x)[1]].append(x)
        for k, xs in own.items():
            centroids[k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = [(i, k, d) for i, x in kept for d, k in [nearest(x)]]
    inertia, most = Counter(), 2**63 - 1
    for _, k, d in out:
        inertia[k] += min(d, most)
    return Counter((i, k, min(d, most), min(inertia[k], most), min(sum(inertia.values()), most)) for i, k, d in out), centroids


def vectors(rng, kind):
    if kind == "balls":  # far apart and narrow, so that balls are assigned whole
        middles = rng.normal(0, 4, (6, 64))
        x = middles[rng.integers(0, 6, 300)] + rng.normal(0, 0.01, (300, 64))
    elif kind == "even":
        x = rng.normal(0, 1, (300, 64))
    else:  # beyond what doubles hold exactly
        x = np.round(rng.normal(0, 1e9, (120, 64)))
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


@pytest.mark.parametrize("kind", ["balls", "even", "large"])
def test_clusters_equal_plain_ones(spark, kind):
    rows = vectors(np.random.default_rng(3), kind)
    rows += [(1000 + i, rows[0][1]) for i in range(90)]  # copies
    rows += [rows[5], (5, rows[6][1]), (None, rows[7][1]), (2000, None), (2001, []), (2002, [1.0] * 63), (2003, [None] * 64), (2004, [float("nan")] * 64), (2005, [float("inf")] * 64)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, distance int").repartition(3)
    found, centroids = ball_clusters.clusters(df, n=12, rounds=4, tree=64, leaf=8)
    want, plain = plain_clusters(rows, 12, 4)
    assert [[int(v) for v in c] for c in centroids] == plain
    assert Counter(map(tuple, found.collect())) == want


def test_clusters_of_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    found, centroids = ball_clusters.clusters(spark.createDataFrame([(7, [0.5] * 64), (8, [0.5] * 64), (9, [-0.25] * 64)], kind))
    assert len(centroids) == 3 and sorted(r.distance for r in found.collect()) == [0, 0, 0] and len({r.cluster for r in found.collect()}) == 2
    found, centroids = ball_clusters.clusters(spark.createDataFrame([(7, [0.5] * 3)], kind))
    assert found.count() == 0 and len(centroids) == 0


def test_narrow_balls_are_assigned_whole():
    rows = vectors(np.random.default_rng(4), "balls")
    x = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64)
    tree = ball_clusters.grown(np.arange(len(x)), np.ones(len(x), bool), x, 8)
    middles = x[:0]
    for row in x:
        if (np.linalg.norm(middles - row, axis=1) > 1000).all():
            middles = np.concatenate([middles, row[None]])
    assert len(middles) == 6
    whole, parts = ball_clusters.assigned(tree, middles)
    in_balls = sum(tree.nodes[b, 1] - tree.nodes[b, 0] for b, _ in whole)
    assert in_balls + sum(len(r) for r, _, _ in parts) == len(x) and in_balls > 0.9 * len(x)
    for ball, near in whole:
        begin, end = tree.nodes[ball, :2]
        assert (ball_clusters.squared(tree.vectors[begin:end], middles).argmin(axis=1) == near).all()
        assert (tree.sums[ball] == tree.vectors[begin:end].sum(axis=0)).all()


def plain_audit(rows, labels):
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    told = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                 "D": bool(re.search("[#$%&*|]", text)), "E": doc_id is not None and first[text] < doc_id}
        told.append((lang or "", fails, doc_id in good, doc_id in toxic))
    out = {}
    for part in {t[0] for t in told}:
        removed_by = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [t for t in told if t[0] == part]
            gone = []
            for step, own in enumerate(order, 1):
                out_now = [t for t in left if t[1][own]]
                redundant = sum(t[1][own] for t in gone)
                left, gone = [t for t in left if not t[1][own]], gone + out_now
                unique = sum(t[0] == part and t[1][own] and sum(t[1].values()) == 1 for t in told)
                removed_by[own] += len(out_now)
                out[part, order, step] = (len(left), len(out_now), redundant, unique, sum(t[2] for t in out_now), sum(t[3] for t in out_now))
        for (p, order, step), counts in list(out.items()):
            if p == part:
                out[p, order, step] = (*counts[:6], removed_by[order[step - 1]])
    return out


@pytest.mark.parametrize("parts", ["1", "3", "40"])
def test_audit_equals_a_plain_one(spark, documents, parts):
    """Also where a run of equal texts goes on over several partitions."""
    rows, df = documents
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 400, 3)] + [(3, 0, 0), (6, None, None), (None, 1, 1), (9999, 1, 1)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {tuple(r[:3]): tuple(r[3:]) for r in found} == plain_audit(rows, labels) and len(found) == 600 * 3


def test_audit_of_empty_tables(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(documents[1].filter("false"), labels).count() == 0
    found = filter_audit.audit(documents[1], labels)
    assert found.filter("good_lost > 0 OR toxic_lost > 0").count() == 0 and found.count() == 1800


def test_failures_of_a_long_text():
    text = ("Ab cd " * 400_000).encode()
    assert filter_audit.failures(text) == 0b0110 and filter_audit.failures(b"") == 0b0001
