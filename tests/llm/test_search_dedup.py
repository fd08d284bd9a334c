"""Top-k search and the two near-duplicate operators against brute force."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from webloom.llm import embedding_dedup, simhash_dedup, topk_search
from webloom.llm.components import connected_components

VECTORS = "vec_id long, embedding array<float>, label int, score string, rank int"


def union(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.fixture(scope="module")
def vectors(spark):
    """Random vectors, clusters of near copies, equal copies and every odd case, with clashing column names."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 16))
    near = np.repeat(base[:3], 40, axis=0) + rng.normal(scale=0.05, size=(120, 16))
    rows = [(i, [float(np.float32(v)) for v in x], i % 3, "s", 1) for i, x in enumerate(np.concatenate([base, near]))]
    rows += [(1000 + i, rows[0][1], 0, "s", 1) for i in range(30)]
    rows += [(2000, None, 0, None, None), (2100, [0.0] * 16, 0, None, None), (2200, [1.0, None] * 8, 1, None, None)]
    rows += [(2300, [float("nan")] * 16, 1, None, None), (2400, [float("inf")] + [1.0] * 15, 1, None, None)]
    rows += [(2500, rows[0][1], None, None, None), (None, rows[0][1], 0, None, None), (2600, [], 0, None, None), (2700, [1.0], 0, None, None)]
    return rows, spark.createDataFrame(rows, VECTORS)


def usable(rows, label=False):
    ok = lambda x: x and all(v is not None and np.isfinite(v) for v in x)
    return [r for r in rows if r[0] is not None and ok(r[1]) and (not label or (r[2] is not None and any(r[1])))]


@pytest.mark.parametrize("block", [16_384, 37])
def test_top_k_is_exact(vectors, block):
    rows, df = vectors
    found = topk_search.top_k(df, df.filter("vec_id % 100 = 0"), 10, query_block=5, block=block).collect()
    good = usable(rows)
    want = set()
    for q in (r for r in good if r[0] % 100 == 0):
        ints = lambda x: [int(np.floor(1024 * v)) for v in x]
        scored = [(-sum(a * b for a, b in zip(ints(q[1]), ints(c[1]), strict=True)), c[0]) for c in good if c[0] != q[0] and len(c[1]) == len(q[1])]
        want |= {(q[0], n + 1, c, -s) for n, (s, c) in enumerate(sorted(scored)[:10])}
    assert {tuple(r) for r in found} == want


def test_top_k_bounds_hold():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(50, 19)), rng.normal(size=(60, 19))
    for n in topk_search.LEVELS:
        assert (topk_search.summary(x, n) @ topk_search.summary(y, n).T >= x @ y.T - 1e-9).all()


def test_top_k_huge_components_and_repeated_rows(spark):
    big = 3e38
    rows = [(0, [big, 1.0]), (100, [1.0, 1.0]), (1, [big, 0.0]), (2, [-big, 0.0]), (2, [-big, 0.0]), (3, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {(r.query_id, r.rank, r.vec_id): r.score for r in topk_search.top_k(df, df.filter("vec_id % 100 = 0")).collect()}
    assert len(found) == 8
    assert found[(0, 1, 1)] == 2**63 - 1 and found[(0, 4, 2)] == -(2**63)
    assert found[(100, 3, 3)] == 1024 * 512 + 1024 * 256


def brute_top_k(rows, k=10):
    """Every row but those of the query's id; equal rows once."""
    rows = sorted({(i, tuple(x)) for i, x in rows})
    ints = lambda x: [int(np.floor(1024 * v)) for v in x]
    want = []
    for i, x in rows:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(ints(x), ints(y), strict=True)), j) for j, y in rows if j != i)
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(want)


@pytest.mark.parametrize("cell_rows, query_block, block", [(40, 2, 25), (8, 1000, 1000), (4096, 3, 50)])
def test_top_k_is_exact_over_many_cells(spark, cell_rows, query_block, block):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(9, 24))
    rows = [(i, (centres[i % 9] + rng.normal(scale=0.2, size=24)).round(3).tolist()) for i in range(900)]
    rows += [(i, rows[0][1]) for i in range(2000, 2100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk_search.top_k(df, df.filter("vec_id % 100 = 0"), 10, query_block, block, cell_rows).collect()
    assert sorted(map(tuple, found)) == brute_top_k(rows)


def test_top_k_takes_every_vector_of_a_repeated_id(spark):
    rows = [(0, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [1.0, 0.0]), (100, [0.0, 1.0]), (100, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk_search.top_k(df, df.filter("vec_id % 100 = 0")).collect()
    assert sorted(map(tuple, found)) == brute_top_k(rows)
    assert sum(r.query_id == 0 and r.vec_id == 2 for r in found) == 2


def test_cells_and_levels_rule_out_pairs_of_clustered_vectors():
    rng = np.random.default_rng(13)
    x = np.floor(1024 * (np.repeat(rng.normal(size=(20, 64)), 200, axis=0) + rng.normal(scale=0.2, size=(4000, 64))))
    cells = topk_search.Cells([*x[::100]])
    near, apart = cells.nearest(x)
    np.maximum.at(cells.radius, near, apart)
    np.add.at(cells.rows, near, 1)
    numbers, bound = cells.bounds(x[::100])
    scores = x[::100] @ x.T
    kth = np.sort(scores, axis=1)[:, -10]
    held = np.stack([np.where(near == n, scores, -np.inf).max(axis=1) for n in numbers], axis=1)
    assert (bound >= held).all() and (bound < kth[:, None]).mean() > 0.5
    _, left = topk_search.search(np.arange(40), x[::100], kth, np.arange(100, 4100), x, 10)
    assert (np.diff(left) <= 0).all() and left[-1] < 0.2 * left[0]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_levels_are_used_on_small_tables(spark, sf):
    """Cells and a threshold for every query; what is multiplied is what the levels leave (all of such even directions)."""
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding", F.size("embedding").cast("long").alias("length"))
    celled, cells, known = topk_search._fitted(rows, None)
    asked = topk_search._thresholds(rows.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), known, 10).toPandas()
    assert len(cells.rows) > 3 and np.isfinite(asked["least"]).all() and sum(len(x) for _, x in known.values()) <= max(rows.count() / 16, 1) + 1
    table = rows.orderBy("vec_id").toPandas()
    q, c = (np.floor(1024 * np.stack(t["embedding"]).astype(float)) for t in (asked, table))
    ids = table["vec_id"].to_numpy()
    found, left = topk_search.search(asked["query_id"].to_numpy(), q, asked["least"].to_numpy(), ids, c, 10)
    assert left[0] == len(q) * (len(c) - 1) and (np.diff(left) <= 0).all()
    scores = (q @ c.T).astype(int)
    for i, place, score in found:
        want = sorted((-s, v) for s, v in zip(scores[i], ids, strict=True) if v != asked["query_id"][i])[:10]
        assert [(-s, v) for s, v in zip(score, ids[place], strict=True)] == want


def test_top_k_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.top_k(df, df).collect() == []


@pytest.mark.parametrize("chunk", [2048, 16])
def test_near_vectors(vectors, chunk):
    rows, df = vectors
    found = embedding_dedup.near_vectors(df, chunk=chunk).collect()
    assert len(found) == len(rows)
    good = usable(rows, label=True)
    x = [np.array(r[1], float) for r in good]
    pairs = [
        (i, j)
        for i in range(len(good))
        for j in range(i + 1, len(good))
        if good[i][2] == good[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / (np.linalg.norm(x[i]) * np.linalg.norm(x[j])) >= 0.93
    ]
    links = np.bincount(np.array(pairs).ravel(), minlength=len(good))
    component = union(len(good), pairs)
    want = {good[i][0]: (links[i], min(good[j][0] for j in range(len(good)) if component[j] == component[i])) for i in range(len(good))}
    for r in found:
        n, least = want.get(r.vec_id, (0, r.vec_id)) if r.vec_id is not None else (0, None)
        assert (r.n_links, r.component_id, r.kept) == (n, least, r.vec_id is not None and least == r.vec_id)


def test_near_vectors_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    apart = np.abs(embedding_dedup._projected(x, 42) - embedding_dedup._projected(y, 42)) / np.sqrt(2 - 2 * 0.93)
    first, others = apart[:, : embedding_dedup.SORTED], apart[:, embedding_dedup.SORTED :]
    hit = (first <= embedding_dedup.FIRST).all(axis=1) & ((others <= embedding_dedup.WINDOW).sum(axis=1) >= embedding_dedup.wanted_count())
    assert hit.mean() > 0.95


def test_few_pairs_of_a_label_are_counted(spark):
    """Windows on the sorted lines leave less than a tenth of the pairs, of which few reach the count."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    apart, pairs, open_, reached = np.sqrt(2 - 2 * 0.93), 0, 0, 0
    for _, own in table.dropna(subset=["label", "embedding"]).groupby("label"):
        x = np.stack([v for v in own["embedding"] if v is not None and len(v) == 64]).astype(float)
        on, rows = embedding_dedup._projected(x, 42), np.arange(len(x))
        i, j = embedding_dedup.in_windows(on, rows, rows, apart)
        i, j = i[i < j], j[i < j]
        kept = embedding_dedup.reaching(on, i, j, apart, embedding_dedup.wanted_count())
        count = (np.abs(on[i, embedding_dedup.SORTED :] - on[j, embedding_dedup.SORTED :]) <= embedding_dedup.WINDOW * apart).sum(axis=1)
        assert set(kept) == set(np.flatnonzero(count >= embedding_dedup.wanted_count()))
        pairs, open_, reached = pairs + len(x) * (len(x) - 1) // 2, open_ + len(i), reached + len(kept)
    assert open_ < 0.1 * pairs and reached < 0.01 * pairs


def test_near_vectors_of_repeated_ids(spark):
    rows = [(5, [1.0, 0.0, 0.0, 0.0], 0), (5, [0.0, 1.0, 0.0, 0.0], 0), (6, [1.0, 0.1, 0.0, 0.0], 0), (7, [0.1, 1.0, 0.0, 0.0], 0), (5, [0.0, 1.0, 0.0, 0.0], 0)]
    found = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == [(5, 1, 5, True), (5, 2, 5, True), (5, 2, 5, True), (6, 1, 5, False), (7, 2, 5, False)]


@pytest.fixture(scope="module")
def near_pairs():
    rng = np.random.default_rng(14)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return x, 0.9301 * x + np.sqrt(1 - 0.9301**2) * side


def test_near_vectors_in_tables_of_cells(spark, near_pairs):
    """Many cells and tables: every pair counts once, and pairs at the threshold are found."""
    x = np.concatenate(near_pairs)
    x = np.concatenate([x, x[:1] + np.random.default_rng(15).normal(scale=0.01, size=(300, 64))])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(df, cell_rows=100, chunk=256).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    assert embedding_dedup.sizes_of_tables(len(x), 0.93, 100)[0] >= 5
    got = np.array([found[i] for i in range(len(x))])
    assert (got <= want).all() and got.sum() > 0.97 * want.sum() and got[1:1500].sum() > 0.95 * want[1:1500].sum()


@pytest.mark.parametrize("rows", [10**5, 10**6, 10**8])
def test_tables_of_cells_keep_recall_and_size(near_pairs, rows):
    depth, tables = embedding_dedup.sizes_of_tables(rows, 0.93)
    x, y = near_pairs
    a, b = (embedding_dedup.cells(v, depth, tables, 42) for v in (x, y))
    assert (a == b).any(axis=1).mean() > 0.98
    # Random vectors that meet one in its cells, as if there were so many rows.
    met = (a[:750, None] == a[None, 750:]).mean(axis=(0, 1)).sum() * rows
    assert met < 4 * tables * embedding_dedup.CELL_ROWS and tables < 64


def test_near_vectors_empty(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints():
    for text in (None, "", " \t\r\n", "one", "Two wOrds", "a b c d", "É ÉÉ é x\x0by\x0cz \xa0 q", "x " * 3000, "<|> \x1c a b"):
        assert simhash_dedup.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_of_a_long_text_in_parts():
    text = " ".join(str(i % 977) for i in range(70_000))
    assert simhash_dedup.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("shard", [4096, 8])
def test_linked_fingerprints_equal_brute_force(spark, shard):
    rng = np.random.default_rng(4)
    prints = {int(x) for x in rng.integers(0, 2**63, 150)}
    for x in [*prints][:60]:
        for _ in range(4):
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(bit)
            prints.add(x)
    prints = np.array(sorted(prints), np.uint64)
    rows = [(i * 3, int(x)) for i, x in enumerate(prints.view(np.int64))]
    df = spark.createDataFrame(rows, "node long, fingerprint long")
    found = dict(map(tuple, connected_components(simhash_dedup.linked(df, shard=shard)).collect()))
    close = np.bitwise_count(prints[:, None] ^ prints) <= 3
    component = union(len(prints), [(i, j) for i, j in zip(*np.nonzero(close), strict=True) if i < j])
    assert [found.get(i * 3, i * 3) for i in range(len(prints))] == [c * 3 for c in component]


@pytest.mark.parametrize("spoil", [0, 0xFFFFFFFF])
def test_large_shards_get_trees_of_their_own(spark, spoil):
    """A sample of 64 gives few shards; spoil: one of the halves is equal in all fingerprints."""
    rng = np.random.default_rng(16)
    prints = rng.integers(0, 2**63, 1500).astype(np.uint64) & ~np.uint64(spoil)
    flips = np.array([sum(1 << int(b) for b in rng.choice(np.arange(32 if spoil else 0, 64), rng.integers(1, 5), replace=False)) for _ in range(600)], np.uint64)
    prints = np.unique(np.concatenate([prints, prints[:600] ^ flips]))
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(prints.view(np.int64))], "node long, fingerprint long")
    held = simhash_dedup.in_shards(df, shard=40, sample=64).cache()
    homes = held.filter("home").groupBy("tree", "node").count()
    assert homes.count() == 2 * len(prints) and homes.filter("count > 1").isEmpty()
    rows = held.filter("home AND tree = 1").groupBy("shard").count().agg({"count": "max"}).first()[0]
    assert rows <= 160
    found = dict(map(tuple, connected_components(simhash_dedup.linked(df, shard=40, sample=64)).collect()))
    close = np.bitwise_count(prints[:, None] ^ prints) <= 3
    component = union(len(prints), [(i, j) for i, j in zip(*np.nonzero(close), strict=True) if i < j])
    assert [found.get(i, i) for i in range(len(prints))] == component


def test_texts_under_one_doc_id_are_documents_of_their_own(spark):
    a, b = ("".join(f"{x}{i} " for i in range(300)) for x in "ab")
    rows = [(5, a), (5, b), (6, a.upper()), (7, b.upper()), (5, b)]
    found = simhash_dedup.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found) == [(5, 5, True)] * 3 + [(6, 5, False), (7, 5, False)]
    kept = simhash_dedup.one_of_each(spark.createDataFrame([*rows, (None, a), (None, a), (8, "other")], "doc_id long, text string"))
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(5, a), (5, b), (None, a), (8, "other")]))
    assert simhash_dedup.one_of_each(kept.filter("false")).collect() == []


def test_fingerprint_in_slices(monkeypatch):
    text = "Éa b\tc " * 500 + "x" * 300 + " end"
    monkeypatch.setattr(simhash_dedup, "SLICE", 50)
    assert simhash_dedup.fingerprint(text) == plain_fingerprint(text)
    assert simhash_dedup.fingerprint(" " * 500 + "one two") == plain_fingerprint("one two")


def test_simhash_groups(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(5, long), (9, long + " tail"), (2, "quite another text of a few words"), (7, None), (8, ""), (3, "  "), (None, long), (9, long + " tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fingerprint", "2 AS node", "'x' AS kept")
    found = sorted((r.doc_id or -1, r.component_id, r.kept) for r in simhash_dedup.simhash_groups(df).collect())
    assert found == sorted([(5, 5, True), (9, 5, False), (9, 5, False), (2, 2, True), (7, 3, False), (8, 3, False), (3, 3, True), (-1, None, True)])
    assert simhash_dedup.simhash_groups(df.filter("false")).collect() == []


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(200, i) for i in range(201, 300)] + [(7, 7), (None, 3)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {i: 1 for i in range(2, 61)} | {i: 200 for i in range(201, 300)}
