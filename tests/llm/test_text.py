"""Language identification and main-text extraction, and the pipeline as a whole."""

from __future__ import annotations

import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from webloom.llm import html_extract, language_id, mixing, queries, runtime, simhash_dedup, token_counts

TREE = html_extract.grow_tree((t := html_extract.labelled_blocks())[:, :-1], t[:, -1])
LOREM = "The quick brown fox jumps over the lazy dog while the cat sleeps on the warm window sill and dreams of mice. "


def test_language_accuracy_on_held_out_documents(spark):
    found = queries.op6_language_id(spark, "/root/testdata/sf0.1")
    docs = runtime.read_table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    assert np.mean([r.rejected for r in rows]) < 0.001
    assert all(0 <= r.score <= 1 for r in rows)


DOCS = "doc_id long, text string, lang string, score string, rejected int"


def test_language_edge_cases(spark):
    rows = [(i, "the house of the rising sun " * 3, "en", "x", 1) for i in range(60)]
    rows += [(100 + i, "das haus und der garten über straße " * 3, "de", "x", 1) for i in range(60)]
    rows += [(500, None, "en", None, None), (501, "", None, None, None), (502, "123 !? ́", "de", None, None), (None, "the sun", "xx", None, None)]
    rows += [(503, "garten straße " * 100_000, None, None, None), (504, "the house", None, None, None), (504, "the house", None, None, None)]
    found = language_id.identify(spark.createDataFrame(rows, DOCS)).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(rows) and by[None].lang_pred == "en"
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (500, 501, 502))
    assert by[503].lang_pred == "de" and by[504].lang_pred == "en"
    assert language_id.identify(spark.createDataFrame([], DOCS)).collect() == []
    bare = language_id.identify(spark.createDataFrame([(1, "text", None, None, None)], DOCS)).collect()
    assert [(r.lang_pred, r.score) for r in bare] == [("und", 0.0)]


FOREIGN = ["Быстрая коричневая лиса прыгает через ленивую собаку", "敏捷的棕色狐狸跳过了懒狗今天天气很好", "Η γρήγορη καφέ αλεπού πηδάει πάνω από το σκυλί", "Nopea ruskea kettu hyppää laiskan koiran yli metsään"]


@pytest.mark.parametrize("left_out", ["de", "en", "es", "fr"])
def test_text_in_an_unlearned_language_is_rejected(spark, left_out):
    docs = runtime.read_table(spark, "/root/testdata/sf0.1", "documents")
    texts, languages = language_id.training_sample(docs.filter(F.col("lang") != left_out))
    model = language_id.train(texts, languages)
    held = docs.filter(language_id.held_out() & (F.char_length("text") > 400)).select("lang", F.substring("text", 1, 4000).alias("text")).limit(1500).collect()
    rejected = model.judged([r.text for r in held])[1]
    unlearned = np.array([r.lang == left_out for r in held])
    assert rejected[unlearned].mean() > 0.9 and rejected[~unlearned].mean() < 0.01
    assert model.judged(FOREIGN)[1].all()


def test_subwords_of_a_batch_are_those_of_its_texts():
    texts = ["Hello world", "", "İ x1y", "éa  b"]
    bucket, row = language_id.subwords(texts)
    for i, text in enumerate(texts):
        alone, _ = language_id.subwords([text])
        assert sorted(bucket[row == i]) == sorted(alone)


def test_long_texts_score_alike_in_slices(monkeypatch):
    model = language_id.train(["the sun"] * 20 + ["das haus"] * 20, ["en"] * 20 + ["de"] * 20)
    text = "the sun of the house " * 500
    whole = model.scores([text, "das haus"])
    monkeypatch.setattr(language_id, "SLICE", 1000)
    assert np.allclose(model.scores([text, "das haus"]), whole, atol=0.01)


PAGE = f"""<!DOCTYPE html><html><head><title>T</title></head><body class="home">
<header class="site-header"><a href=/>Home</a> Site name</header><div class="cookie-notice">We use cookies, ok?</div>
<nav><a href=1>a</a></nav><article><header><h1>My title</h1></header><p>{LOREM * 3}<p>Short &lt;one&gt; &amp caf&eacute;<br>x.
<ul><li>item one</li><li>item <a href=x>two</a></li></ul><div class="advert">Buy now</div><form><label>Your mail</label></form>
<p>{LOREM}</p><section id="comments"><p>Nice article, {LOREM}</p></section></article><aside>{LOREM}</aside>
<footer>c 2020</footer><script>var x="<p>no</p>"</script></body></html>"""


def test_main_text():
    want = ["My title", (LOREM * 3).strip(), "Short <one> & café x.", "item one", "item two", LOREM.strip()]
    assert html_extract.main_text(PAGE, TREE) == "\n\n".join(want)


def test_main_text_without_containers():
    page = f"<body><div><a href=a>Home</a> <a href=b>News</a></div><table><tr><td>{LOREM * 2}</td></tr></table><div>{LOREM * 3}</div><div><a href=z>Next page</a></div>"
    assert html_extract.main_text(page, TREE) == f"{(LOREM * 2).strip()}\n\n{(LOREM * 3).strip()}"


def test_the_tree_learns_its_table_and_needs_words_and_links():
    assert all((html_extract.tree_score(TREE, tuple(r[:-1])) >= 0.5) == r[-1] for r in t)
    for grades in ((0, 1, 1), (0, 0.5, 0.5), (0, 0, 1), (0.5, 1, 1)):
        assert set(t[(t[:, 6:9] == grades).all(axis=1), -1]) == {0, 1}


LONG, TWICE, FULL = LOREM.strip(), (LOREM * 2).strip(), (LOREM * 6).strip()


@pytest.mark.parametrize(
    "page, text",
    [
        # A small block with a name of content is no container of content.
        (f"<div class='post-date'>12 May</div><div><p>{TWICE}</p><p>{FULL}</p></div>", [TWICE, FULL]),
        # One that holds most of the text is; a long block beside it belongs to the article.
        (f"<div class='entry-content'><p>{FULL}</p><p>Short.</p></div><div>{TWICE}</div><div><a href=n>Next page</a></div>", [FULL, "Short.", TWICE]),
        # So are several of one class.
        ("".join(f"<div class='post-body'><p>{TWICE}</p><p>Yes, {i}.</p></div>" for i in range(4)), [x for i in range(4) for x in (TWICE, f"Yes, {i}.")]),
        # Sections of an article by names that boilerplate has, too.
        (f"<article><p>{LONG}</p><section class='discussion'><h2>Discussion</h2><p>{FULL}</p></section></article>", [LONG, "Discussion", FULL]),
        (f"<article><p>{LONG}</p><div class='warning'><p>{FULL}</p></div></article>", [LONG, FULL]),
        (f"<article><p>{LONG}</p><div class='notice'><a href=x>Sign up</a></div></article>", [LONG]),
        # Runs of links in an article, and the text beside a teaser.
        (f"<article><p>{LONG}</p><ul><li><a href=a>One more</a><li><a href=b>Two more</a></ul></article>", [LONG]),
        (f"<div><p>{FULL}</p></div><article><p>A teaser</p></article>", [FULL, "A teaser"]),
        (f"<div><p>{FULL}</p></div><aside><article>A card</article></aside>", [FULL]),
    ],
)
def test_words_and_links_decide_in_and_beside_containers(page, text):
    assert html_extract.main_text(f"<body>{page}</body>", TREE).split("\n\n") == text


HEAD, FOOT = "<nav><a href=/>Home</a></nav>", "<div class='sidebar'><p>Latest news of all kinds</p></div><footer>c 2020</footer>"


@pytest.mark.parametrize("wrapper", ["<form action=/x>", "<div class='layout has-sidebar'>", "<div class='header-fixed'>", "<div class='page social'>", "<div id=with-comments>", "<fieldset>"])
@pytest.mark.parametrize("article", ["<article>", "<main>", "<div role=main>", "<div>"])
def test_a_container_of_the_whole_page_is_no_boilerplate(wrapper, article):
    tags = [re.match(r"<(\w+)", x)[1] for x in (wrapper, article)]
    page = f"<body>{wrapper}{HEAD}{article}<h1>My title</h1><p>{FULL}</p><p>{TWICE}</p></{tags[1]}>{FOOT}</{tags[0]}></body>"
    assert html_extract.main_text(page, TREE).split("\n\n") == ["My title", FULL, TWICE]


def test_reader_comments_are_left_out_however_long():
    many = "".join(f"<article class=comment><p>{FULL}</p></article>" for _ in range(9))
    for section in ("<section id=comments>", "<div class='comment-list'>", "<div>"):
        page = f"<body><article><h1>My title</h1><p>{TWICE}</p></article>{section}{many}</{section[1:4].replace('sec', 'section')}></body>"
        assert html_extract.main_text(page, TREE) == f"My title\n\n{TWICE}"


ROW, LAST = "<div><a href=a>Home</a> <a href=b>News</a> <a href=c>About us</a></div>", "<div>Copyright 2020 Example</div>"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"{ROW}<div><h1>A title</h1><p>He said no.</p><p>{FULL}</p><p>It rained.</p><p>{LONG}</p><p>He left.</p><p>She stayed.</p><p>{FULL}</p></div>{LAST}", ["A title", "He said no.", FULL, "It rained.", LONG, "He left.", "She stayed.", FULL]),
        (f"{ROW}<div><h1>A title</h1><p>{LONG}</p><p>It rained.</p><p>{FULL}</p><h2>Second</h2><p>Yes.</p><p>{FULL}</p></div>{LAST}", ["A title", LONG, "It rained.", FULL, "Second", "Yes.", FULL]),
        (f"<div><h1>T one</h1><p>{FULL}</p><p>{LONG}</p></div><div class='responses'><article class='msg'><p>{FULL}</p></article><article class=msg><p>{LONG}</p></article></div>", ["T one", FULL, LONG]),
        (f"<article><h1>T one</h1><p>{LONG}</p></article><div class='responses'><article class='msg'><p>{FULL}</p></article><article class=msg><p>{LONG}</p></article></div>", ["T one", LONG]),
        (f"<article><p>{LONG}</p><p style='color: red; display: none'>{LONG}</p><div style='visibility:hidden'>x y</div><p>{FULL}</p></article>", [LONG, FULL]),
        (f"<article><p>{LONG} Press <button>OK</button> to go on.</p><button>Share</button></article>", [f"{LONG} Press OK to go on."]),
        ("<p>Hello world.</p>", ["Hello world."]),
        ("<h1>Note</h1><p>Hello world.</p>", ["Note", "Hello world."]),
        ("<ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul>", [""]),
    ],
)
def test_pages_of_plain_layouts(page, text):
    assert html_extract.main_text(f"<body>{page}</body>", TREE).split("\n\n") == text


def test_blocks_of_other_layouts_are_told():
    """Pages that aren't among the labelled ones: other mixes of containers and lengths, marked alike."""
    rng = np.random.default_rng(7)
    n = lambda low, high: int(rng.integers(low, high))
    hits = Counter()
    for i in range(200):
        menu = "".join(f"<li><a href=#>{{={n(1, 4)}}}</a></li>" for _ in range(n(3, 9)))
        tale = "".join(f"<p>{{+{n(1, 9) if rng.random() < 0.3 else n(15, 140)}}}</p>" for _ in range(n(4, 12)))
        tale = f"<h1>{{+{n(2, 12)}}}</h1><p>{{+{n(40, 90)}}}</p>{tale}"
        body = [f"<article>{tale}</article>", f"<main><div>{tale}</div></main>", f"<div class='post-content'>{tale}</div>", f"<div><div>{tale}</div></div>", f"<div role=main>{tale}</div>"][i % 5]
        side = [f"<aside><h3>{{=2}}</h3><p>{{={n(5, 60)}}}</p></aside>", f"<div class='widget-area sidebar'><ul>{menu}</ul></div>", ""][i % 3]
        page = f"<body><header><div>{{=2}}</div><nav><ul>{menu}</ul></nav></header>{body}{side}<footer><p>{{={n(4, 30)}}}</p></footer></body>"
        found = html_extract.blocks(html_extract._filled(page, lambda sign, size: size))
        for block, row in zip(found, html_extract.features(found), strict=True):
            hits[block[0].startswith("keep"), html_extract.tree_score(TREE, row) >= 0.5] += 1
    precision, recall = (hits[True, True] / (hits[True, True] + hits[x]) for x in ((False, True), (True, False)))
    assert precision > 0.97 and recall > 0.97, (precision, recall)


@pytest.mark.parametrize("tag", ["<div>", "<div class=content>", "<div class=c{}>", "<form>", "<b>"])
def test_deep_pages_take_time_in_proportion(tag):
    page = "".join(tag.format(i) for i in range(20_000)) + f"<p>{FULL}</p>" + "</i></x>" * 20_000
    began = time.monotonic()
    assert html_extract.main_text(page, TREE) == FULL
    assert time.monotonic() - began < 3


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<", ""),
        ("<p", ""),
        ("<article>a<b>c</article>x", "ac"),
        ("<article>x &amp; y <!-- c --> z<script>q</script>w</article", "x & y zw"),
        ("<article><p>a &am", "a &am"),
        ("<article>1 < 2 <a", "1 < 2"),
        ("<article><p>" + "x " * 50_000 + "</article>", ("x " * 50_000).strip()),
    ],
)
def test_odd_pages(page, text):
    assert html_extract.main_text(page, TREE) == text


def test_extract_rows(spark):
    rows = [(1, "u", "<article>a</article>"), (1, "u", "<article>a</article>"), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    assert sorted(map(str, map(tuple, html_extract.extract_main_text(df).collect()))) == ["(1, 'u', 'a', 1)"] * 2 + ["(None, None, '', 0)"]
    assert html_extract.extract_main_text(df.filter("false")).collect() == []


def test_pipeline_stages(spark, sf_dir):
    docs = runtime.read_table(spark, sf_dir, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language_id"](spark, docs.unionByName(docs.limit(1).withColumn("text", F.lit("123"))), sf_dir)
    assert told.columns == columns and told.count() == docs.count()
    kept = stages["near_dedup"](spark, docs.unionByName(docs.limit(3)), sf_dir)
    from webloom.llm.simhash_dedup import simhash_groups

    want = {r.doc_id for r in simhash_groups(docs).filter("kept").collect()}
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == columns and sorted(ids) == sorted(want)
    mixed = stages["mixing"](spark, docs, sf_dir)
    assert mixed.columns == columns
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "start", "length", "sequence_id"} <= set(pieces.columns) and pieces.count() > 0
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} <= {r.doc_id for r in docs.collect()}


def brute_groups(rows):
    """The rows that one_of_each keeps, by comparing all pairs of plain fingerprints."""
    from test_search_dedup import plain_fingerprint, union

    prints = [plain_fingerprint(r.text) for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    component = union(len(rows), near)
    return {min(r.doc_id for r, c in zip(rows, component, strict=True) if c == own) for own in set(component)}


def test_pipeline_equals_a_plain_version(spark, sf_dir):
    """Every stage on what its predecessor kept: groups by all pairs, words by target, each token once."""
    stages = dict(corpus_pipeline.STAGES)
    docs = runtime.read_table(spark, sf_dir, "documents")
    told = runtime.checkpointed(stages["language_id"](spark, docs, sf_dir))
    once = runtime.checkpointed(stages["near_dedup"](spark, told, sf_dir))
    assert sorted(r.doc_id for r in once.collect()) == sorted(brute_groups(told.collect()))
    assert once.exceptAll(docs).isEmpty()
    mixed = runtime.checkpointed(stages["mixing"](spark, once, sf_dir))
    words = lambda rows: Counter({s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows if r.source == s) for s in {r.source for r in rows}})
    size, taken = words(once.collect()), words(mixed.collect())
    order = sorted(size, key=lambda s: (s is None, s))
    for source, target in zip(order, mixing.share_targets([size[s] for s in order], ([1, 2, 3] * len(order))[: len(order)]), strict=True):
        assert abs(taken[source] - target) <= mixing.BLOCK_WORDS
    tokenizer = Tokenizer.from_file(token_counts.tokenizer_path())
    want = Counter()
    for r in mixed.collect():
        want[r.doc_id] += len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
    for pieces in (stages["packing"](spark, mixed, sf_dir).collect(), corpus_pipeline.run(spark, sf_dir).collect()):
        got = Counter()
        for r in pieces:
            got[r.doc_id] += r.length
        assert got == want


def test_pipeline_stages_of_odd_tables(spark, sf_dir):
    columns = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, key string, rank int, copies int"
    rows = [(i, "the house of the rising sun and the garden " * (i % 5 + 1), "en", None if i % 3 else "s", 1, 1, "r", None, 1, 2) for i in range(40)]
    rows += [(90, None, None, None, None, None, None, None, None, None), (91, "", "en", "s", 0, 1, "r", "k", 1, 1), (None, "the house and the sun", None, "s", 1, 1, "r", "k", 1, 1)]
    rows += [(92, "the garden " * 60_000, "en", "t", 1, 1, "r", "k", 1, 1)] + [(93, "a house in the sun", "en", "t", 1, 1, "r", "k", 1, 1)] * 3
    df = spark.createDataFrame(rows, columns)
    for docs in (df, df.filter("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = runtime.checkpointed(stage(spark, docs, sf_dir))
            assert name == "packing" or out.columns == df.columns
            assert out.isEmpty() == docs.isEmpty()
            docs = out if name != "packing" else docs
    kept = {r.doc_id: r.n for r in corpus_pipeline.STAGES[1][1](spark, df, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert kept[None] == 1 and kept[90] == 1 and 91 not in kept and kept[93] == 1


def test_stages_leave_other_columns_alone(spark, sf_dir):
    extra = "_row string, _id string, row string, id string, score string, rejected string, lang_pred int, key string, own int, fingerprint string, root string"
    values = ("r", "i", "w", "d", "s", "no", 7, "k", 3, "f", "t")
    rows = [(i, "the house of the rising sun and the garden " * (i % 5 + 1) + str(i), "en", "s", 1, *values) for i in range(40)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = runtime.checkpointed(stage(spark, docs, sf_dir))
        found = docs.collect()
        assert found and {tuple(r[5:]) for r in found} == {values}, name


def test_near_copies_of_rows_with_maps(spark):
    rows = [(2, "a b c", {"x": 1}), (1, "a b c", {"x": 2}), (1, "a b c", {"x": 2}), (3, "other words here", None)]
    found = simhash_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>")).collect()
    assert sorted((r.doc_id, r.more) for r in found) == [(1, {"x": 2}), (3, None)]


def test_every_query_runs(spark, sf_dir):
    for name, query in queries.queries().items():
        assert query(spark, sf_dir).count() > 0, name
