"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into text blocks at its block-level tags. A block has the word count and
link density of itself and of the blocks before and after it, and grades for the
containers it stands in: sure by their tags or roles, likely by their names alone. Names,
forms and headers say nothing if the container holds the page's article or most of its
words, as many pages wrap all they have in one. A decision tree, grown on the blocks of the
small labelled pages below, tells the blocks of the article from the rest.

Time and memory are in proportion to a page's length, however deep it is nested.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.markup import VOID, attributes, decoded, scan

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup"
    " option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split()
)
DROPPED = frozenset("script style noscript template svg math iframe object canvas head audio video textarea title".split())
BOILERPLATE_TAGS = frozenset("nav footer aside menu dialog select button search".split())
_UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.IGNORECASE)
#: Tags that can wrap the whole page, too.
WRAPPERS = frozenset("form fieldset header".split())
BOILERPLATE_ROLES = frozenset(
    "navigation banner contentinfo complementary search menu menubar toolbar alert alertdialog dialog status".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
BOILERPLATE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted nav navbar"
    " navigation menu menubar breadcrumb breadcrumbs header masthead footer foot sidebar aside side rail notice notices"
    " cookie cookies consent gdpr alert warning popup modal overlay subscribe subscription newsletter signup login"
    " register search share sharing social follow related recommended recommendations trending widget toolbar pager"
    " pagination comment comments commentlist disqus respond responses reply replies discussion feedback copyright legal"
    " disclaimer skip hidden".split()
)
#: Of these the words that name sections of an article, too; words and links decide there.
MAYBE_BOILERPLATE = frozenset("alert warning notice notices discussion feedback legal disclaimer social search follow register".split())
#: Words that name the readers' part of a page, also on an article.
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond responses reply replies".split())
#: Words that name the article's own head inside it, and elements that never are boilerplate as a whole.
IN_ARTICLE = frozenset("header head banner masthead text".split())
WHOLE = frozenset("html body article main".split())
#: Elements in which a button is part of the text.
INLINE_HOLDERS = frozenset("p span b i em strong a code kbd".split())
CONTENT_WORDS = frozenset("article content post entry story main maincontent articlebody body text hentry".split())

SEED = 42
FEATURES = "before_words before_links words links after_words after_links boilerplate content page_has_content heading near paragraph"
#: Parts of the labelled pages. {+n} stands for n words of the article, {-n} for n words that aren't, {=n} for such in what is never an
#: article, whatever its length; a block goes by its first word.
_NAV = "<nav><ul><li><a>{=1}</a></li><li><a>{=1}</a></li><li><a>{=2}</a></li></ul></nav>"
_LINKS = "<ul><li><a>{-1}</a></li><li><a>{-2}</a></li><li><a>{-3}</a></li></ul>"
_ROW = "<div><a>{-1}</a> <a>{-2}</a> <a>{-1}</a></div>"
_FOOT = "<footer>{=8} <a>{=2}</a></footer>"
_SIDE = "<div class=sidebar><h3>{-2}</h3><ul><li><a>{-3}</a></li><li><a>{-4}</a></li></ul><p>{-14}</p><p>{-70}</p></div>"
_ASIDE = "<aside><h2>{=2}</h2><p>{=40}</p><p>{=110}</p><a>{=3}</a></aside>"
_REPLIES = "<div class=comments><h3>{-1}</h3><div><p>{-12}</p><p>{-60}</p></div><div><p>{-130}</p></div></div>"
_FORM = "<form><label>{-2}</label><p>{-15}</p><p>{-60}</p><button>{-1}</button></form>"
_TEASERS = "<div><h3><a>{-5}</a></h3><p>{-9}</p></div><div><h3><a>{-6}</a></h3><p>{-11} <a>{-2}</a></p></div>"
_TALE = "<h1>{+7}</h1><p>{+60}</p><p>{+3}</p><p>{+90}</p><p>{+2}</p><p>{+3}</p><p>{+40}</p>"
#: Labelled pages with articles in an element of their own, whose blocks can have any length: what stands inside the body.
IN_ELEMENTS = (
    f"{_NAV}<div class=ad>{{-7}}</div><article>{_TALE}<ul><li>{{+4}}</li><li>{{+9}}</li></ul></article>{_FOOT}",
    f"{_NAV}<div class=ad>{{-20}}</div><article><h1>{{+2}}</h1><p>{{+2}}</p></article>{_FOOT}",
    f"<article>{{+1}}</article><div>{{-1}}</div>",
    f"<article>{{+3}}</article>",
    f"<article>{{+5}}</article><div>{{-3}}</div>",
    f"<article><p>{{+30}}</p><button>{{-1}}</button><p>{{+20}}</p><button>{{-1}}</button></article><button>{{-1}}</button>",
    f"<article><p>{{+22}}</p><section class=discussion><h2>{{+1}}</h2><p>{{+130}}</p></section></article>",
    f"<article><p>{{+22}}</p><div class=warning><p>{{+130}}</p></div></article>",
    f"<article><p>{{+22}}</p><div class=notice><a>{{-2}}</a></div></article>",
    f"<article><p>{{+22}}</p>{_LINKS}</article>",
    f"<article><p>{{+6}}</p><p>{{+2}}</p><p>{{+3}} <a>{{+1}}</a></p></article>",
    f"<article><p>{{+30}}</p><ul><li>{{+2}}</li><li>{{+1}} <a>{{+1}}</a></li></ul><div class=advert>{{-2}}</div><form><label>{{-2}}</label></form><p>{{+22}}</p></article>",
    f"<div><p>{{+130}}</p></div><aside><article>{{-2}}</article></aside>",
    f"<div><p>{{+40}}</p><p>{{+60}}</p></div><aside><article><p>{{-20}}</p></article></aside>",
    f"<article><p>{{+12}}</p></article>{_FOOT}",
    f"{_ROW}<article><p>{{+40}}</p><ul><li>{{+2}}</li><li>{{+1}} <a>{{+1}}</a></li><li>{{+3}} <a>{{+2}}</a></li></ul><p>{{+22}}</p><h2>{{+1}}</h2><p>{{+90}}</p></article>",
    f"{_NAV}<main>{_TALE}<table><tr><td>{{+2}}</td><td>{{+3}}</td></tr></table><blockquote>{{+30}}</blockquote></main>{_ASIDE}{_FOOT}",
    f"<header><div>{{-3}}</div>{_NAV}</header><main><h2>{{+5}}</h2><p>{{+50}}</p>{_LINKS}<p>{{+40}}</p><p><a>{{+6}}</a></p><p>{{+70}}</p></main>{_SIDE}",
    f"{_ROW}<article><h1>{{+6}}</h1><p>{{+35}} <a>{{-4}}</a></p><p><a>{{+20}}</a> {{+2}}</p><p>{{+80}}</p></article><div>{{-9}}</div><p>{{-15}}</p>{_LINKS}",
    f"{_ROW}<article><p>{{+200}}</p><p>{{+150}}</p></article><div><p>{{+140}}</p></div><div>{{-30}} <a>{{-20}}</a></div>{_ROW}",
    f"<article>{_TALE}</article>{_REPLIES}{_FORM}{_FOOT}",
    f"{_SIDE}<article><p>{{+8}}</p><p>{{+30}}</p><nav>{{-30}}</nav><aside>{{-50}}</aside><p>{{+45}}</p><form><p>{{-30}}</p></form></article>",
    f"<article><div class=notice><p>{{-8}}</p><p>{{-3}}</p></div><h1>{{+4}}</h1><p>{{+60}}</p><div class=discussion><h2>{{+1}}</h2><p>{{+80}}</p><p>{{-4}} <a>{{-3}}</a></p></div></article>",
    f"<article><p>{{+60}}</p><div class=warning><p>{{+30}}</p><p>{{+45}}</p></div><div class=social><a>{{-1}}</a> <a>{{-1}}</a></div></article><div class=legal><p>{{-30}}</p><p>{{-9}}</p><p>{{+130}}</p></div>",
)
#: Other labelled pages, whose lengths matter.
PAGES = (
    # Long and short blocks beside an article.
    f"{_NAV}<div>{{-14}}</div><article><h1>{{+3}}</h1><p>{{+4}}</p></article>{_FOOT}",
    f"{_NAV}<div>{{-40}}</div><article><h1>{{+6}}</h1><p>{{+12}}</p></article>{_FOOT}",
    f"{_NAV}<div>{{-25}}</div><article><h1>{{+2}}</h1><p>{{+2}}</p></article>{_FOOT}",
    f"{_NAV}<div>{{-20}}</div><article><h1>{{+8}}</h1><p>{{+90}}</p></article><div>{{-20}}</div>{_FOOT}",
    # Containers that have such a name.
    f"{_ROW}<div class=content>{_TALE}{_ROW}</div>{_SIDE}<div>{{-5}}</div>",
    f"{_NAV}<div id=content><h1>{{+3}}</h1><p>{{+25}}</p><p>{{+4}}</p><p>{{+4}} <a>{{+2}}</a></p>{_LINKS}</div><div>{{+60}}</div><div>{{-12}}</div>{_FOOT}",
    f"<div class=entry><p>{{+45}}</p><p>{{+1}}</p></div><p>{{-3}}</p><div class=entry><p>{{+60}}</p></div><div>{{-8}} <a>{{-8}}</a></div>",
    f"<div class=post><h2>{{+4}}</h2><p>{{+110}}</p><p>{{+5}}</p><div class=notice>{{-10}}</div><p>{{+50}}</p></div>{_REPLIES}{_ROW}",
    f"{_ROW}<div class=story><h1>{{+8}}</h1><p>{{+70}}</p><div class=legal><p>{{+45}}</p><p>{{-6}}</p></div></div><div><p>{{+40}}</p><a>{{-2}}</a></div>",
    f"<div class=entry><p>{{+130}}</p><p>{{+1}}</p></div><div>{{+44}}</div><div><a>{{-2}}</a></div>",
    f"<div><p>{{+130}}</p></div><article><p>{{+2}}</p></article>{_FOOT}",
    # Nothing but divs, tables and paragraphs.
    f"{_ROW}<div>{_TALE}</div><div>{{-4}}</div>",
    f"{_ROW}<div><h1>{{+4}}</h1><p>{{+3}}</p><p>{{+80}}</p><p>{{+2}}</p><p>{{+20}}</p><p>{{+2}}</p><p>{{+2}}</p><p>{{+90}}</p></div><div>{{-3}} <a>{{-2}}</a></div>",
    f"{_ROW}<h1>{{+5}}</h1><p>{{+30}}</p><h2>{{+2}}</h2><p>{{+1}}</p><p>{{+70}}</p><p>{{+3}}</p>{_LINKS}<div>{{-5}}</div>",
    f"{_ROW}<div><h1>{{+3}}</h1><p>{{+22}}</p><p>{{+2}}</p><p>{{+90}}</p><h2>{{+1}}</h2><p>{{+1}}</p><p>{{+88}}</p></div><div>{{-3}}</div>",
    f"{_LINKS}<div><h1>{{+3}}</h1><p>{{+2}}</p><p>{{+3}}</p><p>{{+100}}</p></div>{_TEASERS}{_ROW}<div>{{-6}}</div>",
    f"<div>{{-3}}</div>{_ROW}<table><tr><td>{_LINKS}</td><td><p>{{+70}}</p><p>{{+4}}</p><p>{{+50}}</p></td></tr></table><div>{{-3}}</div>",
    f"{_ROW}<table><tr><td>{{+45}}</td></tr></table><div>{{+70}}</div><div><a>{{-2}}</a></div>",
    f"{_ROW}<div>{{+60}}</div><div>{{+30}}</div><div>{{+25}}</div><div><a>{{-3}}</a></div><div>{{-2}}</div>",
    f"<div class=date>{{-2}}</div><div><p>{{+45}}</p><p>{{+130}}</p></div><div>{{-3}}</div>",
    "{-1}", "{+30}", "<p>{+2}</p>", "<h1>{+1}</h1><p>{+2}</p>", "<p>{+9}</p>", "<div>{+35}</div>", "<p>{+35}</p><p>{+3}</p>", "<h2>{+3}</h2><p>{+8}</p><p>{+12}</p>", "<p>{+12}</p><p>{+3}</p><p>{+14}</p>",
    # Pages without an article.
    f"{_ROW}{_LINKS}<div>{{-4}}</div>", f"{_NAV}{_TEASERS}{_FOOT}", f"<h2>{{-2}}</h2>{_LINKS}<h2>{{-3}}</h2>{_LINKS}", f"{_ROW}<div>{{-5}} <a>{{-9}}</a></div>{_ROW}", f"{_NAV}{_ASIDE}{_FOOT}", f"{_ROW}<div>{{-2}}</div><div>{{-4}}</div>",
    # Boilerplate around and between.
    f"<div class=cookie-notice>{{-25}}</div>{_ROW}<div>{_TALE}</div><div class=related><h2>{{-2}}</h2><p>{{-40}}</p></div><div class=newsletter><h3>{{-4}}</h3><p>{{-25}}</p></div>{_FOOT}",
    f"<header><h1>{{-3}}</h1><p>{{-9}}</p></header><div>{_TALE}</div>{_REPLIES}<footer><p>{{-45}}</p></footer>",
    f"{_ROW}<div class=notice>{{-4}}</div><div><p>{{+60}}</p><div class=warning>{{+60}}</div><p>{{+70}}</p></div><div class=follow>{{-9}} <a>{{-9}}</a></div>",
    f"<div class=social>{{-110}} <a>{{-70}}</a></div><div><p>{{+110}}</p></div><div>{{-8}} <a>{{-8}}</a></div>",
)
SCALES, DRAWS = (0.35, 0.7, 1.0, 1.6, 3.0), 8
#: What can stand around any of them.
AROUND = (("", ""), (_ROW, _FOOT), (f"{_NAV}<div class=ad>{{=6}}</div>", "<div>{-3}</div>"))
_SLOT = re.compile(r"\{([-+=])(\d+)\}")


def _filled(page: str, size) -> str:
    """A labelled page with words in its slots, size(sign, number) for each; the first word tells the label."""
    return _SLOT.sub(lambda m: " ".join(["keep" if m[1] == "+" else "drop", *["word"] * (size(m[1], int(m[2])) - 1)]), page)


def _scaled(scale: float):
    """Lengths times a scale; those of three words and fewer stay."""
    return lambda sign, n: n if n < 4 else max(4, round(n * scale))


def _drawn(rng: np.random.Generator):
    """Any length for the blocks of an article and of what never is one, the others as they are."""
    return lambda sign, n: n if sign == "-" else int(np.exp(rng.uniform(0, np.log(200 if sign == "+" else 60))))


def features(found: list[tuple]) -> list[tuple]:
    """FEATURES of the blocks of a page. ``near`` is the most words outside of links in one of the two blocks on either side."""
    has = max((b[4] for b in found if b[3] < 1), default=0.0)
    plain = [b[1] * (1 - b[2]) if b[3] < 1 else 0.0 for b in found]
    out = []
    for i, (_, words, links, boilerplate, content, heading, paragraph) in enumerate(found):
        before = found[i - 1][1:3] if i else (0, 0.0)
        after = found[i + 1][1:3] if i + 1 < len(found) else (0, 0.0)
        near = max(plain[max(0, i - 2) : i] + plain[i + 1 : i + 3], default=0.0)
        out.append((*before, words, links, *after, boilerplate, content, has, heading, near, paragraph))
    return out


def labelled_blocks() -> np.ndarray:
    """The labelled table: FEATURES and whether a block belongs to the article, a row a different block of the labelled pages."""
    rows = {}
    rng = np.random.default_rng(SEED)
    ways = [(page, around, _scaled(scale)) for page, around, scale in product(IN_ELEMENTS + PAGES, AROUND, SCALES)]
    ways += [(page, around, _drawn(rng)) for page, around, _ in product(IN_ELEMENTS, AROUND, range(DRAWS))]
    for page, around, size in ways:
        found = blocks(f"<body>{_filled(around[0] + page + around[1], size)}</body>")
        for block, row in zip(found, features(found), strict=True):
            rows.setdefault(row, []).append(block[0].startswith("keep"))
    # A block that looks like another is labelled as most of them are.
    return np.array([(*row, 2 * sum(labels) >= len(labels)) for row, labels in rows.items()], float)


def grow_tree(x: np.ndarray, y: np.ndarray, least: int = 1, depth: int = 24):
    """A decision tree of least Gini impurity: a share of positives, or (feature, cut, below, above)."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return float(y.mean())
    best = None
    for feature in range(x.shape[1]):
        values = np.unique(x[:, feature])
        for cut in (values[1:] + values[:-1]) / 2:
            below = x[:, feature] < cut
            n, p, q = below.sum(), y[below].mean(), y[~below].mean()
            if min(n, len(y) - n) >= least:
                impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, feature, float(cut), below)
    if best is None:
        return float(y.mean())
    _, feature, cut, below = best
    return (
        feature,
        cut,
        grow_tree(x[below], y[below], least, depth - 1),
        grow_tree(x[~below], y[~below], least, depth - 1),
    )


def tree_score(tree, row: tuple) -> float:
    """The share of positives in the leaf of a row."""
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree


@dataclass(frozen=True)
class _Container:
    """What an element says of the blocks inside it, from tag, role and name.

    ``parent`` is the place of the container around it. ``never``: no article is inside;
    ``doubt``: likely none, by this grade; ``sure``: it is an article; ``name``: its name if it has a word of content.
    """

    parent: int
    never: bool
    doubt: float
    comments: bool
    sure: bool
    name: str


def _container(parent: int, tag: str, attrs: str, in_content: bool) -> _Container | None:
    """The container that an element is, if its tag or attributes say anything."""
    found = attributes(attrs) if attrs else {}
    role = found.get("role", "").lower()
    name = f"{found.get('class', '')} {found.get('id', '')}" if found else ""
    named = {w.lower() for w in _WORDS.findall(name)}
    comments = bool(named & COMMENT_WORDS) and tag not in ("html", "body")
    unwanted = named & (BOILERPLATE_WORDS - IN_ARTICLE if in_content else BOILERPLATE_WORDS)
    if tag in WHOLE:
        unwanted = named & COMMENT_WORDS if comments else set()
    never = tag in BOILERPLATE_TAGS or role in BOILERPLATE_ROLES or "hidden" in found or bool(_UNSEEN.search(found.get("style", "")))
    wrapper = tag in WRAPPERS and not (tag == "header" and in_content)
    doubt = 1.0 if wrapper or unwanted - MAYBE_BOILERPLATE else 0.5 if unwanted else 0.0
    sure = not never and not doubt and (tag in ("article", "main") or role in ("main", "article"))
    content = "" if never or doubt or tag in ("html", "body") or not named & CONTENT_WORDS else found.get("class", name)
    return _Container(parent, never, doubt, comments, sure, content) if never or doubt or sure or content else None


def _around(i: int, containers: list[_Container]) -> Iterator[int]:
    """A container and all around it."""
    while i >= 0:
        yield i
        i = containers[i].parent


def _held(at: list[tuple[int, float]], containers: list[_Container]) -> list[float]:
    """The words inside each container, of (container, words) of blocks."""
    held = [0.0] * len(containers)
    for i, words in at:
        if i >= 0:
            held[i] += words
    for i in reversed(range(len(containers))):
        if containers[i].parent >= 0:
            held[containers[i].parent] += held[i]
    return held


def _grades(at: list[tuple[int, float]], containers: list[_Container]) -> list[tuple[float, float]]:
    """Grades as boilerplate and as content of each container, from the (container, words not in links) of blocks."""
    n, held = len(containers), _held(at, containers)
    never: list[bool] = []
    for c in containers:
        never.append(c.never or (c.parent >= 0 and never[c.parent]))
    total = sum(words for i, words in at if i < 0 or not never[i])
    articles = [i for i in range(n) if containers[i].sure and not never[i] and held[i]]
    replies: list[bool] = []  # inside a readers' part
    for c in containers:
        replies.append(c.comments or (c.parent >= 0 and replies[c.parent]))
    nearly_all = [5 * held[i] >= 4 * total for i in range(n)]
    wrapped = any(c.comments and nearly_all[i] for i, c in enumerate(containers))
    articles = [i for i in articles if not replies[i]] or (articles if wrapped else [])
    article = max(articles, key=lambda i: held[i], default=-1)
    around = set(_around(article, containers))
    boilerplate: list[float] = []
    for i, c in enumerate(containers):
        most = 2 * held[i] > total and (article < 0 or (held[article] < held[i] and not c.comments)) and (nearly_all[i] or not c.comments)
        own = 1.0 if c.never else 0.0 if most or i in around else c.doubt
        boilerplate.append(max(own, boilerplate[c.parent] if c.parent >= 0 else 0.0))
    kept = [(i, words) for i, words in at if i < 0 or boilerplate[i] < 1]
    held, named = _held(kept, containers), Counter()
    for i, c in enumerate(containers):
        if c.name:
            named[c.name] += held[i]
    likely = {name for name, words in named.items() if 2 * words > sum(w for _, w in kept)}
    content: list[float] = []
    for c in containers:
        own = 1.0 if c.sure else 0.5 if c.name in likely else 0.0
        content.append(max(own, content[c.parent] if c.parent >= 0 else 0.0))
    return list(zip(boilerplate, content, strict=True))


def blocks(source: str) -> list[tuple[str, int, float, float, float, bool, bool]]:
    """The text blocks of a page: text, words, link density, grades as boilerplate and content, heading, paragraph.

    Content is 1 in an article or main element, and 0.5 in containers that have such a
    name and, all of one class together, most of the page's words.
    """
    found: list[tuple[str, int, float, int, bool, bool]] = []  # text, words, link density, container, heading, paragraph
    containers: list[_Container] = []
    stack: list[tuple[str, int, bool]] = []  # open elements: tag, container, whether it is in content
    open_: Counter[str] = Counter()  # their tags, and the names of content around
    parts: list[str] = []
    linked = dropped = headings = 0

    def flush() -> None:
        nonlocal linked
        words = " ".join(decoded("".join(parts)).split())
        if words:
            n = words.count(" ") + 1
            found.append((words, n, min(1.0, linked / n), stack[-1][1] if stack else -1, headings > 0, open_["p"] > 0))
        parts.clear()
        linked = 0

    def pop() -> None:
        nonlocal dropped, headings
        tag, own, _ = stack.pop()
        open_[tag] -= 1
        dropped -= tag in DROPPED
        headings -= tag in HEADINGS
        if own >= 0 and containers[own].name and (not stack or stack[-1][1] != own):
            open_[f"name {containers[own].name}"] -= 1

    def push(tag: str, attrs: str) -> None:
        nonlocal dropped, headings
        _, around, in_content = stack[-1] if stack else ("", -1, False)
        own = _container(around, tag, attrs, in_content) if attrs or tag in BLOCK_TAGS else None
        if own and own.name and open_[f"name {own.name}"]:  # inside another of that name, which counts its words
            own = replace(own, name="") if own.never or own.doubt or own.sure else None
        if own:
            containers.append(own)
            around, in_content = len(containers) - 1, in_content or own.sure or bool(own.name)
            open_[f"name {own.name}"] += bool(own.name)
        stack.append((tag, around, in_content))
        open_[tag] += 1
        dropped += tag in DROPPED
        headings += tag in HEADINGS

    for kind, name, attrs in scan(source):
        if kind in ("text", "cdata"):
            if not dropped and kind == "text":
                parts.append(name)
                if open_["a"]:
                    linked += len(name.split())
            continue
        tag = name.lower()
        if tag == "button" and stack and stack[-1][0] in INLINE_HOLDERS:
            tag = "span"  # words of a sentence
        if tag in BLOCK_TAGS:
            flush()
        elif tag == "br" and not dropped:
            parts.append(" ")
        if kind == "close":
            if open_[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
        elif tag == "body":
            # A body ends the head, and links in it, even if their end tags are missing.
            while open_["a"] or dropped:
                pop()
            push(tag, attrs)
        elif kind == "open" and tag not in VOID:
            if tag in BLOCK_TAGS and stack and stack[-1][0] == "p":
                pop()
            push(tag, attrs)
    flush()
    grades = _grades([(b[3], b[1] * (1 - b[2])) for b in found], containers) + [(0.0, 0.0)]
    return [(text, n, links, *grades[i], heading, paragraph) for text, n, links, i, heading, paragraph in found]


def main_text(source: str | None, tree) -> str:
    """The blocks of a page that the tree takes for its article, joined by blank lines; empty if none."""
    found = blocks(source or "")
    return "\n\n".join(b[0] for b, row in zip(found, features(found), strict=True) if tree_score(tree, row) >= 0.5)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of (page_id, url, html).

    References are decoded, white space inside a block becomes one space, and blocks in
    page order are joined by two line ends. A null or empty page, or one without an
    article, has the text "". Broken and truncated markup is read as far as it goes, a
    tag cut off at the end is dropped. Repeated rows get a row each; other columns are
    ignored; an empty table gives no rows.
    """
    table = labelled_blocks()
    tree = grow_tree(table[:, :-1], table[:, -1])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py(), tree) for x in batch.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), texts], ["page_id", "url", "text"]
            )

    read = pages.select(F.col("page_id").cast("long"), "url", "html")
    found = read.mapInArrow(extract, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
