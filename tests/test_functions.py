"""Pinned inputs and results of scalar functions and parsers."""

from __future__ import annotations

import gzip
import math
import re
import time

import numpy as np
import plain_blocks
import pytest
from pyspark.sql import functions as F

from webloom.functions import markup, urls, wire
from webloom.operators import discovery, domain_intel, evaluation, fetch_policy, images, metadata, patterns, readability, search
from webloom.sources import blocks, bodies, dom, feeds, search_results, sinks


def value(spark, make, *inputs):
    """The result of a column function for string inputs."""
    df = spark.createDataFrame([inputs], [f"c{i}" for i in range(len(inputs))])
    return df.select(make(*[F.col(c) for c in df.columns])).first()[0]


@pytest.mark.parametrize(
    "ref, want",
    [
        ("g", "http://a/b/c/g"),
        ("./g", "http://a/b/c/g"),
        ("g/", "http://a/b/c/g/"),
        ("/g", "http://a/g"),
        ("//g", "http://g"),
        ("?y", "http://a/b/c/d;p?y"),
        ("g?y", "http://a/b/c/g?y"),
        ("#s", "http://a/b/c/d;p?q#s"),
        ("..", "http://a/b/"),
        ("../g", "http://a/b/g"),
        ("../..", "http://a/"),
        ("../../g", "http://a/g"),
        ("../../../g", "http://a/g"),
        ("mailto:x@y", "mailto:x@y"),
        ("", "http://a/b/c/d;p?q"),
    ],
)
def test_url_join(spark, ref, want):
    assert value(spark, urls.join, "http://a/b/c/d;p?q", ref) == want


@pytest.mark.parametrize("url, want", [("https://e.com/page#s", "https://e.com/page"), ("https://e.com/page/", "https://e.com/page"), ("https://e.com/", "https://e.com/")])
def test_crawl_key(spark, url, want):
    assert value(spark, urls.crawl_key, url) == want


@pytest.mark.parametrize(
    "name, want",
    [("www.example.co.uk", "example.co.uk"), ("sub.example.com.au", "example.com.au"), ("a.b.c.example.com", "example.com"), ("localhost", "localhost"), ("example.com.", "example.com")],
)
def test_apex(spark, name, want):
    assert value(spark, urls.apex_domain, name) == want


@pytest.mark.parametrize("name, want", [("foo.bar.example.com", "whois.verisign-grs.com"), ("wikipedia.org", "whois.pir.org"), ("example.unknowntld", "whois.iana.org"), ("x.co.uk", "whois.nic.uk")])
def test_whois_server(spark, name, want):
    assert value(spark, urls.whois_server, name) == want


def test_internal_links(spark):
    check = lambda url, page: value(spark, urls.is_internal, url, page)
    assert check("#x", "e.com") and check("mailto:a@b", "e.com") and check("https://www.e.com/x", "e.com")
    assert not check("https://o.com/", "e.com") and not check("/x", "")


@pytest.mark.parametrize("text", ["before 2020-01-01", "14-Aug-2024", "2025-06-01", "2024-08-14T01:02:03Z", "14.08.2024", "August 14, 2024", "20240814", "2024/08/14"])
def test_whois_dates(spark, text):
    assert value(spark, domain_intel.whois_date, text) is not None


@pytest.mark.parametrize("server, want", [("Apache/2.4.52 (Ubuntu)", "Apache"), ("WeirdServer/9.9", "WeirdServer"), ("CustomServer", "CustomServer"), ("", None)])
def test_server(spark, server, want):
    assert value(spark, domain_intel.server_software, server) == want


@pytest.mark.parametrize(
    "banner, port, want",
    [
        ("SSH-2.0-OpenSSH_8.9p1 Ubuntu-3", 1, ("ssh", "OpenSSH", "8.9p1", 0.95)),
        ("220 mail.example.com ESMTP Postfix", 1, ("smtp", "Postfix", None, 0.9)),
        ("220 (vsFTPd 3.0.5)", 1, ("ftp", "vsFTPd", "3.0.5", 0.9)),
        ("+OK Dovecot ready", 1, ("pop3", "Dovecot", None, 0.85)),
        ("HTTP/1.1 200 OK\r\nServer: nginx/1.24.0\r\n", 1, ("http", "nginx", "1.24.0", 0.9)),
        ("-NOAUTH Authentication required", 1, ("redis", "Redis", None, 0.8)),
        ("", 22, ("ssh", None, None, 0.3)),
        ("", 4, ("unknown", None, None, 0.0)),
    ],
)
def test_banners(spark, banner, port, want):
    df = spark.createDataFrame([(banner, port)], "b string, p int")
    found = domain_intel.fingerprint(F.col("b"), F.col("p"))
    assert tuple(df.select(*[found[k] for k in ("service", "product", "version", "confidence")]).first()) == want


@pytest.mark.parametrize("text, want", [("Acme Inc.", "Inc."), ("Tech L.L.C., LLC", "L.L.C."), ("Bar S.r.l.", "S.r.l."), ("LLCfoo", None), ("ltd", None)])
def test_entity_forms(spark, text, want):
    assert value(spark, lambda c: metadata.legal_text(c)["entity_form"], text) == want


def test_legal_text(spark):
    get = lambda text, k: value(spark, lambda c: metadata.legal_text(c)[k], text)
    assert get("is organized under the laws of the State of Nevada", "jurisdiction") == "Nevada"
    uk = "registered in England and Wales, Company Number: 12345678"
    assert (get(uk, "jurisdiction"), get(uk, "registration_number")) == ("England and Wales", "12345678")
    assert get("Company No. 09-876543", "registration_number") == "09-876543"


def test_mail_records(spark):
    spf = lambda text: value(spark, lambda c: domain_intel.spf(c)["status"], text)
    assert [spf(f"v=spf1 {q}all") for q in "-~?+"] == ["configured", "configured", "weak", "weak"]
    assert value(spark, lambda c: domain_intel.dmarc(c)["status"], "v=DMARC1; p=none") == "weak"


@pytest.mark.parametrize("text, want", [("120px", 120), ("48", 48), ("x", None), ("", None), (" 5 ", 5)])
def test_pixels(spark, text, want):
    assert value(spark, images.to_int, text) == want


@pytest.mark.parametrize("text, want", [("0.5", 0.5), ("0", 0.0), ("1", 1.0), ("1.5", None), ("-1", None), ("x", None)])
def test_priority(spark, text, want):
    assert value(spark, feeds.sitemap_priority, text) == want


@pytest.mark.parametrize(
    "text, want",
    [("Thu, 21 May 2026 08:51:10 -0400", "2026-05-21 12:51:10"), ("2026-05-21T08:51:10-04:00", "2026-05-21 12:51:10"), ("21 May 2026 08:51:10 GMT", "2026-05-21 08:51:10"), ("soon", None), ("", None)],
)
def test_feed_dates(spark, text, want):
    assert value(spark, lambda c: feeds.feed_date(c).cast("string"), text) == want


@pytest.mark.parametrize("url, want", [("https://8.8.8.8/", True), ("http://10.1.2.3/", False), ("http://localhost/", False), ("ftp://e.com/", False), ("http://[::1]/", False), ("http://169.254.169.254/x", False), ("https://e.com:8443/", True)])
def test_url_policy(spark, url, want):
    assert value(spark, fetch_policy.url_allowed, url) is want


def test_feeds_of_every_kind():
    assert feeds.feed_rows("<html><body>no</body></html>") == ({"format": "unknown"}, [])
    head, items = feeds.feed_rows('<!DOCTYPE x [<!ENTITY e SYSTEM "file:///etc/passwd">]><rss><channel><title>t</title><item><title>&e; x</title><link>l</link></item><item><description>none</description></item></channel></rss>')
    assert head["format"] == "rss" and [i["title"] for i in items] == ["&e; x"]
    _, items = feeds.feed_rows("<rss><channel><item><title>a</title><guid>http://g</guid><description>" + "d" * 3000 + "</description></item><item><title>b</ti")
    assert items[0]["link"] == "http://g" and len(items[0]["description"]) == 2001 and len(items) == 2
    assert feeds.feed_rows("") == ({"format": "unknown"}, [])


def test_feeds_keep_everything_unless_bounded(spark):
    body = "<rss><channel>" + "".join(f"<item><title>t{i}</title><description>{'d' * 2500}</description></item>" for i in range(1100)) + "</channel></rss>"
    docs = spark.createDataFrame([(1, body)], "feed_id long, body string")
    longest = F.max(F.length("description")).alias("longest")
    assert tuple(feeds.parse_feeds(docs).agg(F.count("*"), longest).first()) == (1100, 2500)
    bounded = feeds.parse_feeds(docs, feeds.MOST_ITEMS, feeds.MOST_DESCRIPTION)
    assert tuple(bounded.agg(F.count("*"), longest).first()) == (1000, 2001)


def test_cache_hits_by_key(spark):
    rows = [("a", 0.0), ("a", 5.0), ("a", 10.0), ("a", 11.0), ("b", 3.0)]
    requests = spark.createDataFrame(rows, "key string, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long")))
    found = {r.key: (r.n_requests, r.n_hits) for r in fetch_policy.cache_hits(requests, F.lit(10)).collect()}
    assert found == {"a": (4, 2), "b": (1, 0)}


def test_top_hits_take_the_first_of_equal_scores(spark):
    rows = [(1, 1, 0, 0.5), (1, 2, 1, 0.9), (2, 1, 1, 0.7), (2, 2, 0, 0.7), (3, 1, 0, 0.8)]
    scored = spark.createDataFrame(rows, "page_id long, nid long, label int, score double")
    assert tuple(evaluation.top_hits(scored).first()) == (3, 2, pytest.approx(2 / 3))


def test_ixbrl_and_prose_are_choices(spark):
    html = "<p>a <ix:nonFraction>1</ix:nonFraction></p><ix:header><p>h</p></ix:header><pre>x\n\ny</pre>"
    pages = spark.createDataFrame([(1, "https://e.com/", html)], "page_id long, url string, html string")
    texts = lambda **how: [(r.node_type, r.text) for r in blocks.blocks(pages, **how).orderBy("block_idx").collect()]
    assert texts() == [("Paragraph", "a 1"), ("CodeBlock", "x\n\ny")]
    assert texts(prose=True) == [("Paragraph", "a 1"), ("Paragraph", "x"), ("Paragraph", "y")]
    assert ("Paragraph", "h") in texts(ixbrl=False)


def test_breadths_of_the_heuristic():
    assert [readability.heuristic_limits(s) for s in (-1, 0.5, 2)] == [(50, 50, 0.4), (200, 25, 0.2), (500, 10, pytest.approx(0.05))]


def test_gunzip(spark):
    assert feeds.bounded_gunzip(gzip.compress(b"abc"), 10) == b"abc" and feeds.bounded_gunzip(b"abc", 1) == b"abc"
    rows = [("a", gzip.compress(b"x" * 100)), ("b", gzip.compress(b"y" * 5000)), ("c", b"plain"), ("d", b"\x1f\x8bbroken"), ("e", None)]
    found = {r.url: (r.body, r.error) for r in feeds.gunzipped(spark.createDataFrame(rows, "url string, packed binary"), 1000).collect()}
    assert found["a"] == ("x" * 100, None) and found["b"][1] == "ValueError" and found["c"] == ("plain", None) and found["d"][1] and found["e"] == ("", None)


def tags(source):
    return [(r["tag"], r["parent"]) for r in dom.parse(source)]


def test_parser_recovers():
    assert tags("<p><b>x<p>y") == [("html", None), ("body", 0), ("p", 1), ("b", 2), ("p", 1)]
    assert tags("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == [("html", None), ("body", 0), ("ul", 1), ("li", 2), ("li", 2), ("ul", 4), ("li", 5), ("li", 2)]
    assert tags("<table><tr><td>1<td>2<tr><th>3</table>") == [("html", None), ("body", 0), ("table", 1), ("tr", 2), ("td", 3), ("td", 3), ("tr", 2), ("th", 6)]
    assert dom.parse("") == [] and tags("plain") == [("html", None), ("body", 0)]
    assert tags('<title>a<b></title><script>"</p>"</script><p>x</x>')[-2:] == [("body", 0), ("p", 3)]


def test_parser_counters():
    rows = {r["tag"]: r for r in dom.parse("<div class='sidebar'><p> Hello, <a href=x>my world</a>. <br></p></div>")}
    p = rows["p"]
    assert (p["text_len"], p["stripped_len"], p["link_len"], p["words"], p["commas"], p["sentences"], p["n_a"], p["n_desc"]) == (18, 16, 8, 3, 1, 1, 1, 2)
    assert rows["a"]["position"] == "sidebar" and rows["div"]["position"] == "body" and rows["a"]["above_negative"]


@pytest.mark.parametrize("tag", ["<div>", "<b>", "<span><p>"])
def test_parser_takes_time_in_proportion_to_depth(tag):
    page = tag * 12_000 + " x " + "</i></b>" * 12_000
    began = time.monotonic()
    rows = dom.parse(page)
    assert time.monotonic() - began < 4 and len(rows) >= 12_000 and rows[1]["stripped_len"] == 1


def test_scanner():
    assert list(markup.scan('a<b x="1>2">c</b><!-- <i> -->d < e<![CDATA[<f>]]><br/><g')) == [
        ("text", "a", ""), ("open", "b", ' x="1>2"'), ("text", "c", ""), ("close", "b", ""), ("text", "d < e", ""), ("cdata", "<f>", ""), ("empty", "br", ""),
    ]
    assert markup.attributes(" A='x&amp;y' b c=\"d\" a=2") == {"a": "x&y", "b": "", "c": "d"}


def test_blocks(spark):
    page = """<h1>T</h1><h7>x</h7><p>a <strong>b</strong> <a href="/l">c</a><a href="javascript:x()">d</a></p><p> </p><ol start=3><li>i<li>j<ul><li>k</ul></ol>
    <pre><code class="language-python">x = 1
y</code></pre><blockquote><p>q</p></blockquote><hr><span class="sr-only">hid</span><dl><dt>t<dd>d</dl><a href="/vote?id=1">up</a>"""
    df = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    found = blocks.blocks(df).orderBy("block_idx").collect()
    assert plain_blocks.page_blocks(page)[2]["md"] == "a **b** [c](/l)d"
    assert [(b["node_type"], b["md"]) for b in found if b["md"]] == [
        ("Heading", "# T"), ("Paragraph", "x"), ("Paragraph", "a **b** [c](/l)d"), ("ListItem", "3. i"), ("ListItem", "4. j"), ("ListItem", "  - k"),
        ("CodeBlock", "```python\nx = 1\ny\n```"), ("Paragraph", "> q"), ("ThematicBreak", "---"), ("DefinitionTerm", "t"), ("Definition", "d"),
    ]
    assert [(b["node_type"], b["parent_idx"], b["number"]) for b in found if not b["md"]] == [
        ("OrderedList", None, 3), ("BulletList", 5, 1), ("BlockQuote", None, None), ("DefinitionList", None, None),
    ]
    assert {(b["uri"], b["mime_type"], b["extractor"]) for b in found} == {("u", "text/html", "webloom")}


def test_targets_of_links_and_pictures(spark):
    page = """<p><a href="/about">About</a> <a href="javascript:alert(1)">Bad</a> and <a href="https://safe.com">safe</a> <a href=" DATA:x">d</a><a href="">e</a></p>
    <img data-src="/real.jpg" src="/x.gif" alt="T"><img src="javascript:x"><figure><img src=f.png><figcaption>F</figcaption></figure><a href="p?q"><h2>H</h2></a>"""
    found = blocks.blocks(spark.createDataFrame([(1, "https://example.com/d/page", page)], "page_id long, url string, html string")).orderBy("block_idx").collect()
    assert [(r.node_type, r.md) for r in found] == [
        ("Paragraph", "[About](https://example.com/about) Bad and [safe](https://safe.com) de"), ("Paragraph", "![T](https://example.com/real.jpg)"),
        ("Figure", ""), ("Paragraph", "![](https://example.com/d/f.png)"), ("Caption", "F"), ("Heading", "## [H](https://example.com/d/p?q)"),
    ]
    assert found[0].text == "About Bad and safe de"


@pytest.mark.parametrize("depth", [200])
def test_blocks_of_deep_and_long_pages(spark, depth):
    """A long paragraph of many pieces takes time in proportion to them."""
    pages = [(1, "u", "<ul><li>" * depth + "x"), (2, "u", "<p>" + "<b>a</b> <i>b</i> " * 50_000), (3, "u", "<div>" * 9000 + "y")]
    began = time.monotonic()
    found = blocks.blocks(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert time.monotonic() - began < 60
    assert {r.page_id: r.text for r in found if r.text}[1] == "x" and sum(r.page_id == 1 for r in found) == 2 * depth
    assert next(r.md for r in found if r.page_id == 2) == " ".join(["**a** *b*"] * 50_000)


def test_cells(spark):
    page = "<table><tr><th>a<th colspan=2>b<tr><td>1<td>2<td>3</table>"
    found = blocks.cells(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).orderBy("row", "col").collect()
    assert [(c["row"], c["col"], c["is_head"], c["text"]) for c in found] == [(0, 0, True, "a"), (0, 1, True, "b"), (1, 0, False, "1"), (1, 1, False, "2"), (1, 2, False, "3")]


ODD_PAGES = [
    "", None, "plain", "<p>a<b> b <i> c </i> </b>d<b></b><em> </em>", "<b>open <p>next</b> x<p><i>y", "<ol><li>a<ol start=5><li>b<p>c</ol><li>d</ol><li>alone",
    "<blockquote><p>a<blockquote>b<br>c</blockquote>d</blockquote>e", "<pre class='lang-c'>\n x <b>y</b><br>z\n</pre><p>t", "<pre data-lang=r><code class=lang-c>q</code></pre>",
    "<p>x<img src=a.png alt=A><img alt=none><img data-src=b><a href='JavaScript:y'>z</a><a>w</a>", "<hr><hr>a<hr>", "<div class='x noprint'>h<p>i</p></div>j<nav>k</nav>",
    "<h2>a <a href='/x'><b> link </b></a> z</h2><dl><dt>t<dd>d<p>e</dl>", "<table><caption>c</caption><tr><td>a<p>b</table>after\u00a0\u2003x", "<a href='hide?id=1'>gone</a>kept<script>s</script>",
    "<p>a<s>b</s><code> c </code><del>d", "<ul><li>a</li></ul><ul><li>b</li><li>c</li></ul><ol start=x><li>d</ol>",
    "<b><b>q<i> r </i></b></b>H<sub>2</sub>O<sup> n</sup><b>x</b><b>y</b>", "<ul><li><p>one</p><p>two<li><pre>c\nd</pre><li><ul><li>deep</ul>tail<li><h3>h</h3>t<blockquote>q<p>r</blockquote></ul>",
    "<table><thead><tr><th>a|b<td>c</thead><tr><td colspan=2>x<p>y<b>z</b><table><tr><td>in<td></table>end<tr><th>1<tr></table>", "<dl><dt>a<dt>b<dd>c<dd>d<dt>e<dd><ul><li>f</ul></dl>",
    "<blockquote><ol start=9><li>a<pre>x\ny</pre><li><table><tr><th>h</table></ol></blockquote><figure><img src=/f.png></figure><figure></figure><ul><li> </li></ul>",
    "<table><tr><td> <td></table><table><caption>c<tr><td><table><tr><td>only</table></table><a href=/x>l <a href=/y>m</a></a><code>a<b>b</b></code><td>stray",
]


@pytest.mark.parametrize("skip", [(), ("nav", "div")])
def test_blocks_equal_a_plain_loop(spark, skip):
    pages = spark.createDataFrame([(i, "u", p) for i, p in enumerate(ODD_PAGES)], "page_id long, url string, html string")
    real = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select((F.col("page_id") + 100).alias("page_id"), "url", "html")
    pages = pages.unionByName(real)
    fields = ("block_idx", "parent_idx", "node_type", "depth", "list_type", "number", "text", "md", "language")
    want = [(r.page_id, *(b.get(f) for f in fields)) for r in pages.collect() for b in plain_blocks.page_blocks(r.html or "", frozenset(skip), r.url)]
    found = [(r.page_id, *(r[f] for f in fields)) for r in blocks.blocks(pages, skip).collect()]
    assert sorted(map(str, found)) == sorted(map(str, want))


def test_cells_equal_a_plain_loop(spark):
    tables = ["<table><thead><tr><td>a<td>b</thead><tr><th>c<td colspan=0>d<td>e</table>", "<table><tr><td><td> x <b>y</b></table><table><td>z</table>", "<p>none", None]
    pages = spark.createDataFrame([(i, "u", p) for i, p in enumerate(tables)], "page_id long, url string, html string")
    fields = ("table_idx", "row", "col", "is_head", "col_span", "text")
    want = [(r.page_id, *(c[f] for f in fields)) for r in pages.collect() for c in plain_blocks.page_cells(r.html or "")]
    assert sorted(map(str, want)) == sorted(str((r.page_id, *(r[f] for f in fields))) for r in blocks.cells(pages).collect())
    nested = spark.createDataFrame([(1, "u", "<table><tr><td>a<table><tr><td>b</table>c<td>d</table>")], "page_id long, url string, html string")
    assert sorted((r.table_idx, r.col, r.text) for r in blocks.cells(nested).collect()) == [(0, 0, "ac"), (0, 1, "d"), (1, 0, "b")]


def test_scope_thresholds():
    assert [round(f(s), 3) for f in (readability.node_threshold, readability.refinement_ratio, readability.sibling_ratio) for s in (0, 0.5, 1)] == [0.72, 0.51, 0.3, 0.82, 0.71, 0.6, 0.42, 0.2, 0.05]


def test_patterns():
    with pytest.warns(UserWarning):
        assert patterns.checked(["a", "(", "(a+)+b", "x" * 600]) == ["a", "(a+)+b", "x" * 600]


@pytest.mark.parametrize("include, path, want", [
    (["(x)y", r"(a)\1"], "/aa", True), (["(x)y", r"(a)\1"], "/ab", False), ([r"(?P<n>a)(?P=n)"], "/aa", True), ([r"(?P<n_1>a)(?P=n_1)"], "/a", False), (["(?P<n>a)"], "/a", True),
    (["(a+)+b"], "/" + "a" * 5000, False), (["a(?=b)"], "/ab", True), (["a(?!b)"], "/ab", False), (["|".join(f"q{i}" for i in range(400))], "/q399", True), ([r"a\Z"], "/ba", True), ([r"(?<!x)a\Z"], "/xa", False),
])
def test_each_pattern_is_matched_on_its_own(spark, include, path, want):
    assert value(spark, lambda c: discovery.matches_patterns(c, include), "https://e.com" + path) is want


@pytest.mark.parametrize("pattern", [r"(a)+\1", r"(?=(a+)+)b", r"(a)?(?(1)b|c)"])
def test_patterns_without_a_bound_are_refused(pattern):
    with pytest.raises(ValueError):
        discovery.matches_patterns(F.col("url"), [pattern])


def test_required_strings_of_patterns():
    cases = {"abc": "abc", "ab*cde": "cde", "ab+cde": "cde", "a|b": "", "x(a|b)yz": "yz", r"\.html$": ".html", r"\d+foo[a-z]bar{2}": "foo", "(?i)abc": "", r"a\x41b": "", "[]a]bc": "bc", "[^]a]bc?": "b", "a{2}b": "b", "^/en/": "/en/", "(abc)?": ""}
    assert {p: patterns.required(p) for p in cases} == cases


def test_texts_against_a_table_of_patterns(spark):
    rng = np.random.default_rng(8)
    pieces = ["ab", "c+", "[xy]", "d?e", r"\d", "f|g", "(h|i)j", "^k", "l$", ".", r"m\.n", "(?i:OP)", "q{2}", "(r+)+s"]
    known = ["".join(rng.choice(pieces, rng.integers(1, 4))) for _ in range(120)] + ["(", "ab"]
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrs0xy."), rng.integers(0, 25))) for _ in range(150)] + ["", None, "ab" * 100, "r" * 3000]
    table = spark.createDataFrame([(i, p) for i, p in enumerate(known)] + [(999, None)], "number int, pattern string")
    with pytest.warns(UserWarning):
        found = patterns.matching(spark.createDataFrame([(i, t, "o") for i, t in enumerate(texts)], "id int, text string, row string"), table)
    want = {(i, n) for i, t in enumerate(texts) for n, p in enumerate(known) if t is not None and p != "(" and "(r+)+s" not in p and re.search(p, t)}
    assert {(r.id, r.number) for r in found.collect() if "(r+)+s" not in r.pattern} == want and found.columns == ["id", "text", "row", "number", "pattern"]
    with pytest.raises(ValueError):
        patterns.matching(table, spark.createDataFrame([(r"(a)\1",)], "pattern string"), text="pattern")


def test_bodies_in_their_charsets(spark):
    rows = [
        ("header", "é name".encode("latin-1"), "text/html; charset=ISO-8859-1", "é name"), ("quoted", "日本".encode("shift_jis"), 'text/html; Charset="Shift_JIS"; x=1', "日本"),
        ("mark", b"\xff\xfe" + "ü€".encode("utf-16-le"), "text/html; charset=utf-8", "ü€"), ("mark8", b"\xef\xbb\xbf" + "ü".encode(), "text/html; charset=latin-1", "ü"),
        ("meta", '<meta charset="koi8-r">Привет'.encode("koi8-r"), None, '<meta charset="koi8-r">Привет'), ("equiv", b'<META http-equiv=x content="text/html; charset=windows-1252">\x80', "text/html", '<META http-equiv=x content="text/html; charset=windows-1252">€'),
        ("unknown", "é".encode(), "text/html; charset=nonsense", "é"), ("broken", b"a\xffb", "", "a\ufffdb"), ("far", b" " * 1100 + b'<meta charset="koi8-r">\xc3\xa9', None, " " * 1100 + '<meta charset="koi8-r">é'),
        ("wide", b"<meta charset=utf-16>x\xc3\xa9", None, "<meta charset=utf-16>xé"), ("comment", b"<!-- <meta charset=koi8-r> -->\xc3\xa9", None, "<!-- <meta charset=koi8-r> -->é"),
        ("none", None, "text/html", None), ("empty", b"", None, ""), ("codec", b"abc", "text/html; charset=rot13", "abc"), ("big", b"\xfe\xff" + "ß".encode("utf-16-be"), None, "ß"), ("half", b"\xff\xfe\x00\xd8", None, "\ufffd"),
    ]
    df = spark.createDataFrame([(*r[:3], "mine") for r in rows], "name string, body binary, content_type string, charset string")
    found = {r.name: r.html for r in bodies.decoded(df).collect()}
    assert found == {r[0]: r[3] for r in rows}


def test_bodies_that_are_too_large(spark):
    df = spark.createDataFrame([(b"abc", "3"), (b"abcd", "4"), (b"abcd", None), (b"ab", "x"), (None, "9"), (None, None)], "body binary, declared string")
    assert [r.e for r in df.select(bodies.body_error(F.col("body"), 3, F.col("declared")).alias("e")).collect()] == [None, "declared too large", "too large", None, "declared too large", None]


def test_max_urls_is_optional(spark):
    entries = spark.createDataFrame([("https://a.com/1", None, 1), ("https://a.com/2", None, 2)], "loc string, lastmod timestamp, seq long")
    links = [("https://a.com/2", True, "content", 1), ("https://a.com/3", True, "content", 2), ("https://b.com/4", True, "content", 3)]
    found = spark.createDataFrame(links, "url string, is_internal boolean, link_type string, seq long")
    urls = lambda most: sorted((r.url[-1], r.source) for r in discovery.discover_urls(entries, found, "a.com", max_urls=most).collect())
    assert urls(None) == [("1", "sitemap"), ("2", "sitemap"), ("3", "page_link")]
    assert urls(2) == urls(None)[:2] and urls(9) == urls(None)


def test_redirect_loops(spark):
    hops = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d")], "source string, target string")
    found = {r.url: r.target for r in discovery.redirect_targets(hops, hops.select(F.col("source").alias("url"))).collect()}
    assert found == {"a": None, "b": None, "c": "d"}


def plain_redirects(hops, url, allowed, most):
    seen, at, n = set(), url, 0
    while True:
        if n <= most and not allowed(at):
            return None, n, "closed", at
        if at not in hops:
            return (at, n, "ok", None) if n <= most else (None, most + 1, "too many", None)
        if at in seen:
            return None, most + 1, "cycle", None
        seen.add(at)
        at, n = hops[at], n + 1


@pytest.mark.parametrize("most", [1, 4, 10])
def test_redirect_paths_equal_a_plain_walk(spark, most):
    rng = np.random.default_rng(most)
    name = lambda i: f"https://h{i}.example.com/" if i % 17 else f"http://10.0.0.{i % 250}/"
    hops = {name(i): name(i + 1) for i in range(200, 259)}  # one long way
    hops |= {name(i): name(int(rng.integers(0, 120))) for i in range(0, 100)} | {name(300): name(300), name(301): name(302), name(302): name(301)}
    starts = sorted({*hops, name(400), "ftp://x/"})
    df = spark.createDataFrame(list(hops.items()) + [(name(400), None), (None, "x")], "source string, target string")
    found = discovery.redirect_paths(df, spark.createDataFrame([(s,) for s in starts], "url string"), fetch_policy.url_allowed, most).collect()
    want = {s: plain_redirects(hops, s, lambda u: u.startswith("https"), most) for s in starts}
    assert {r.url: tuple(r)[1:] for r in found} == want and {w[2] for w in want.values()} >= {"ok", "closed", "cycle"}
    relative = spark.createDataFrame([("https://e.com/a/b", "../c?x")], "source string, target string")
    assert discovery.redirect_paths(relative, relative.selectExpr("source AS url")).first().target == "https://e.com/c?x"


def test_correlation_takes_the_latest_open_request(spark):
    log = [(1, "request"), (2, "request"), (3, "response"), (4, "response"), (5, "response"), (6, "request"), (7, "response")]
    df = spark.createDataFrame([(i, 1, "u", k, i, 200) for i, k in log], "id long, session_id long, url string, kind string, ts long, status int")
    assert {r.id: r.request_id for r in discovery.correlate(df).collect()} == {3: 2, 4: 1, 5: None, 7: 6}


def test_robots_order(spark):
    docs = spark.createDataFrame([("h", "User-agent: a\nUser-agent: b\nDisallow: /x\nAllow: /x/y\n\nUser-agent: *\nDisallow:\n")], "host string, body string")
    asked = spark.createDataFrame([("https://h/x/y",), ("https://h/z",), ("https://other/x",)], "url string")
    ask = lambda agent: {r.url: r.allowed for r in fetch_policy.robots_allowed(asked, docs, agent).collect()}
    assert ask("b/2.0") == {"https://h/x/y": False, "https://h/z": True, "https://other/x": True} and all(ask("zzz").values())


def test_search_ranks_rare_terms_first(spark):
    docs = spark.createDataFrame([(1, "the cat the\nthe dog\nthe the the rare\n\nnothing")], "doc_id long, text string")
    found = search.bm25(search.passages(docs), "the rare", 2).orderBy("rank").collect()
    assert [r.text for r in found] == ["the the the rare", "the cat the"]


def test_wire_formats_survive_noise():
    assert wire.dns_txt(b"") is None and wire.snmp_text(b"\x30") is None and wire.banner_service(None) is None
    assert wire.banner_service(b"E\0\0\0x") == "postgresql " and wire.decoded_banner(b"\xe9") == "é"


def test_duckduckgo_dedups():
    page = '<div class="result"><a class="result__a" href="u">A</a></div><div class="result"><a class="result__a" href="u">B</a></div>'
    assert search_results._scraped(page, 5) == [("A", "u", "")]


def test_confusion(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "t int, g int")
    r = evaluation.confusion(rows, F.col("t") == 1, F.col("g") == 1).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 1) and math.isclose(r.f1, 2 / 3)


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "https://www.a.com/x", "t"), (2, "https://b.com/", "u")], "page_id long, url string, text string")
    for kind in ("parquet", "json", "text"):
        sinks.write_documents(docs, str(tmp_path / kind), kind)
        assert sorted(p.name for p in (tmp_path / kind).glob("host=*")) == ["host=a.com", "host=b.com"]
    with pytest.raises(ValueError):
        sinks.write_documents(docs, str(tmp_path / "x"), "doc")
    sinks.write_store(spark.createDataFrame([("abc", "v")], "key string, value string"), str(tmp_path / "store"))
    assert [tuple(r) for r in sinks.read_store(spark, str(tmp_path / "store")).collect()] == [("abc", "v")]
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages/p.html").write_text("<p>x")
    assert sinks.read_html_files(spark, str(tmp_path / "pages")).first().html == "<p>x"
