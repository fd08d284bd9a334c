"""The node table: one row for each element of each page, from one parse.

``nodes(pages)`` parses raw HTML inside an Arrow function and returns typed rows; all
further work is DataFrame expressions over them. Counters fold up when an element is
closed and context flags are handed down when it is opened, so a page costs time in
proportion to its length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions import fixed
from webloom.functions.markup import VOID, attributes, decoded, scan
from webloom.runtime import MOST_ROWS, portions, spread

#: Elements whose start closes an open paragraph, and the elements that a start tag implicitly ends,
#: by the optional-tag rules of the HTML specification.
BLOCK = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr main menu nav ol p pre search section table ul".split()
)
ENDS = {
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}),
    "th": frozenset({"td", "th"}),
    "option": frozenset({"option"}),
    "thead": frozenset({"tr", "td", "th", "tbody"}),
    "tbody": frozenset({"tr", "td", "th", "thead", "tbody"}),
}
#: Elements at whose tags a word ends; it goes on across those of other, inline elements.
PARTING = BLOCK | frozenset("html head body title caption colgroup col thead tbody tfoot tr td th li dt dd br img option optgroup select legend figcaption summary noscript template".split())
#: An implied end doesn't reach beyond these.
SCOPES = frozenset({"table", "ul", "ol", "dl", "div", "article", "section", "body", "html", "td", "th", "select"})
#: Elements that neither they nor their text count for content.
SKIPPED = frozenset({*fixed.STRIPPED_TAGS, "template"})
#: Elements whose whole text is kept with the row.
WITH_TEXT = frozenset("a title h1 h2 h3 h4 h5 h6 p li td th pre code figcaption blockquote dt dd caption option".split())
INTERACTIVE = frozenset({"button", "input", "select", "textarea", "option", "label"})
HEADINGS = frozenset({"h1", "h2", "h3", "h4"})
PARAGRAPHS = frozenset({"p", "pre", "blockquote"})
SCORED = frozenset({"p", "pre", "td"})
CONTENT_TAGS = frozenset({"main", "article", "section"})
BOILERPLATE_TAGS = frozenset({"aside", "nav", "header", "footer", "form"})
_POSITIVE = re.compile(fixed.POSITIVE_NAMES, re.IGNORECASE)
_NEGATIVE = re.compile(fixed.NEGATIVE_NAMES, re.IGNORECASE)
LANDMARKS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "sidebar"}
_NAMED = re.compile("nav|menu|sidebar|footer|breadcrumb|pagination|pager", re.IGNORECASE)
_SENTENCE = re.compile("[.!?]+")
_HEAD = frozenset({"title", "meta", "link", "base", "style", "script", "head"})

COUNTERS = ("text_len", "words", "commas", "sentences", "link_len", "n_desc", "n_a", "n_interactive", "n_heading", "n_para", "n_li")
FLAGS = ("positive", "negative", "above_positive", "above_negative", "under_content", "under_boilerplate")
SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        *[T.StructField(c, T.IntegerType()) for c in ("nid", "parent", "last_desc", "depth", "sib_idx")],
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        *[T.StructField(c, T.IntegerType()) for c in COUNTERS],
        T.StructField("stripped_len", T.IntegerType()),
        T.StructField("paragraph_score", T.DoubleType()),
        *[T.StructField(c, T.BooleanType()) for c in ("block_child", "skipped", *FLAGS)],
        T.StructField("position", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


class _Element:
    __slots__ = ("tag", "row", "position", "first_text", "children", "counts", "skipped", "score")

    def __init__(self, tag: str, row: dict, position: str, first_text: int, skipped: bool) -> None:
        self.tag, self.row, self.position, self.first_text = tag, row, position, first_text
        self.children, self.counts, self.skipped, self.score = 0, [0] * len(COUNTERS), skipped, 0.0


def _position(tag: str, attrs: dict[str, str], above: str) -> str:
    """The landmark that a link inside the element is counted to."""
    if tag in LANDMARKS:
        return LANDMARKS[tag]
    named = f"{attrs.get('class', '')} {attrs.get('id', '')}" if attrs else ""
    if named and _NAMED.search(named):
        low = named.lower()
        return "footer" if "footer" in low else "sidebar" if "sidebar" in low or "aside" in low else "nav"
    return above


def parse(source: str, events: list | None = None, counted: bool = True) -> list[dict]:
    """The elements of a page in document order; html and body are supplied where they are missing.

    events, if given, gets ("open", row), ("text", text) and ("close", row) in order. Where ``counted`` is false, rows hold
    nid, tag, attrs and skipped only, which takes a third of the time.
    """
    rows: list[dict] = []
    stack: list[_Element] = []
    open_tags: defaultdict[str, int] = defaultdict(int)
    texts: list[str] = []
    begins, solid = [0], []  # where each text begins in all characters, and the texts that aren't blank
    shared = 0  # open elements that hold both the last text and what comes next
    parted = False  # whether a block began or ended since the last text

    def push(tag: str, attrs: dict[str, str]) -> None:
        nonlocal parted
        parted = parted or tag in PARTING
        above = stack[-1] if stack else None
        if not counted:
            skipped = tag in SKIPPED or (above is not None and above.skipped)
            row = {"nid": len(rows), "tag": tag, "attrs": [*attrs.items()] if attrs else [], "skipped": skipped}
            rows.append(row)
            if events is not None:
                events.append(("open", row))
            stack.append(_Element(tag, row, "", 0, skipped))
            open_tags[tag] += 1
            return
        row = {"nid": len(rows), "parent": above.row["nid"] if above else None, "depth": len(stack), "tag": tag}
        row |= {"sib_idx": above.children if above else 0, "attrs": list(attrs.items()), "block_child": False}
        if above:
            above.children += 1
            above.row["block_child"] |= tag in BLOCK
        position = _position(tag, attrs, above.position if above else "body")
        row["position"] = above.position if above else "body"
        named = " ".join(filter(None, (attrs.get("class"), attrs.get("id")))) if attrs else ""
        row["positive"], row["negative"] = bool(_POSITIVE.search(named)), bool(_NEGATIVE.search(named))
        up = above.row if above else dict.fromkeys(FLAGS, False)
        row["above_positive"] = up["positive"] or up["above_positive"]
        row["above_negative"] = up["negative"] or up["above_negative"]
        row["under_content"] = up["under_content"] or bool(above and above.tag in CONTENT_TAGS)
        row["under_boilerplate"] = up["under_boilerplate"] or bool(above and above.tag in BOILERPLATE_TAGS)
        row["skipped"] = tag in SKIPPED or bool(above and above.skipped)
        rows.append(row)
        if events is not None:
            events.append(("open", row))
        stack.append(_Element(tag, row, position, len(texts), row["skipped"]))
        open_tags[tag] += 1

    def blank_edges(first: int) -> int:
        """The white space at both ends of the texts from the first on."""
        at = bisect_left(solid, first)
        if at == len(solid):
            return begins[-1] - begins[first]
        low, high = texts[solid[at]], texts[solid[-1]]
        lead = begins[solid[at]] - begins[first] + len(low) - len(low.lstrip())
        return lead + begins[-1] - begins[solid[-1] + 1] + len(high) - len(high.rstrip())

    def pop() -> None:
        nonlocal shared, parted
        gone = stack.pop()
        parted = parted or gone.tag in PARTING
        open_tags[gone.tag] -= 1
        shared = min(shared, len(stack))
        row, own = gone.row, gone.counts
        if events is not None:
            events.append(("close", row))
        if not counted:
            return
        row["last_desc"] = len(rows) - 1
        if gone.tag in WITH_TEXT:
            row["text"] = "".join(texts[gone.first_text :])
        row["stripped_len"] = max(own[0] - blank_edges(gone.first_text), 0) if own[0] else 0
        if gone.tag in SCORED and row["stripped_len"]:
            gone.score += 1 + min(own[2], 6) * 0.4 + min(row["stripped_len"] // 120, 3)
        row["paragraph_score"] = gone.score
        if gone.tag == "a":
            own[4] += own[0]
        row |= dict(zip(COUNTERS, own, strict=True))
        if stack and gone.tag not in SKIPPED:
            up = stack[-1].counts
            stack[-1].score += gone.score
            for i, n in enumerate(own):
                up[i] += n
            up[5] += 1
            for i, kinds in ((6, ("a",)), (7, INTERACTIVE), (8, HEADINGS), (9, PARAGRAPHS), (10, ("li",))):
                up[i] += gone.tag in kinds

    def close(tag: str) -> None:
        if open_tags[tag]:
            while stack[-1].tag != tag:
                pop()
            pop()

    def in_head() -> bool:
        return len(stack) > 1 and stack[1].tag == "head"

    def open_(tag: str, attrs: dict[str, str], empty: bool) -> None:
        if tag == "html" and stack:
            return
        if not stack and tag != "html":
            push("html", {})
        if tag == "body" and open_tags["body"]:
            return
        head = in_head()
        if tag not in ("html", "head", "body") and not open_tags["body"] and tag not in _HEAD and not head:
            push("body", {})
        if tag == "body" or (head and tag not in _HEAD and tag not in ("html", "noscript", "template")):
            close("head")
            if tag != "body" and not open_tags["body"]:
                push("body", {})
        if tag in BLOCK and open_tags["p"]:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at].tag in SCOPES:
                    break
                if stack[at].tag == "p":
                    while len(stack) > at:
                        pop()
                    break
        ends = ENDS.get(tag)
        for at in range(len(stack) - 1, -1, -1) if ends and any([open_tags[t] for t in ends]) else ():
            if stack[at].tag in ends:
                while len(stack) > at:
                    pop()
                if tag not in ("tr", "thead", "tbody"):
                    break
            elif stack[at].tag in SCOPES:
                break
        push(tag, attrs)
        if empty or tag in VOID:
            pop()

    for kind, name, source_attrs in scan(source):
        if kind == "text":
            if not stack and not name.strip():
                continue
            if not stack:
                open_("body", {}, False)
            own = stack[-1]
            if own.tag in ("script", "style"):
                own.row["raw"] = name
                continue
            if own.skipped:
                continue
            text = decoded(name)
            if not counted:
                if events is not None:
                    events.append(("text", text))
                continue
            if shared and not parted and text and not texts[-1][-1:].isspace() and not text[:1].isspace():
                stack[shared - 1].counts[1] -= 1  # a word goes on across a tag
            parted = parted and not text
            if text.strip():
                solid.append(len(texts))
            texts.append(text)
            begins.append(begins[-1] + len(text))
            shared = len(stack)
            if events is not None:
                events.append(("text", text))
            counts = own.counts
            counts[0] += len(text)
            counts[1] += len(text.split())
            counts[2] += text.count(",")
            counts[3] += len(_SENTENCE.findall(text))
        elif kind == "close":
            if name.lower() not in ("html", "body"):
                close(name.lower())
        elif kind in ("open", "empty"):
            open_(name.lower(), attributes(source_attrs) if source_attrs else {}, False)
    while stack:
        pop()
    return rows


def nodes(pages: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """The node table of pages (page_id, url, html), or of the given tags only.

    ``nid`` numbers elements in document order from 0 and ``last_desc`` is the largest
    number inside an element, so containment is a range. ``position`` is the nearest
    landmark above. A null or empty page has no rows. Tags are filtered inside the
    parser, so an operator that needs links only ships links.
    """
    wanted = frozenset(tags) if tags else None
    names = [f.name for f in SCHEMA]
    kinds = {f.name: k for f, k in zip(SCHEMA, _arrow_kinds(), strict=True)}

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in portions(batches):
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for row in parse(html or ""):
                    if wanted is None or row["tag"] in wanted:
                        row["page_id"], row["url"] = page_id, url
                        rows.append(row)
                if len(rows) > MOST_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[n]) for n in names], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[n]) for n in names], names)

    return spread(pages.select(F.col("page_id").cast("long"), "url", "html")).mapInArrow(parsed, SCHEMA)


#: The elements of a page in one array.
HELD = pa.list_(pa.struct([("nid", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("raw", pa.string()), ("text", pa.string())]))
HELD_TYPE = T.ArrayType(T.StructType([SCHEMA[c] for c in ("nid", "tag", "attrs", "raw", "text")]))


def page_nodes(pages: DataFrame, tags: list[str]) -> DataFrame:
    """pages with ``nodes`` instead of html: a row a page, its elements of the given tags in document order, for what is told of single pages.

    A page without any element has no row. Nothing is shuffled; columns beside html go through.
    """
    wanted, kept = frozenset(tags), [c for c in pages.columns if c not in ("page_id", "html")]
    read = pages.select(F.col("page_id").cast("long"), *kept, "html")
    schema = T.StructType([*read.schema.fields[:-1]]).add("nodes", HELD_TYPE)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 512):
            each = [parse(html or "") for html in batch.column("html").to_pylist()]
            held = [[{k: row.get(k) for k in ("nid", "tag", "attrs", "raw", "text")} for row in rows if row["tag"] in wanted] for rows in each]
            there = pa.array([bool(rows) for rows in each], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(held, HELD)], [*batch.schema.names[:-1], "nodes"]).filter(there)

    return spread(read).mapInArrow(parsed, schema)


CELLS = "page_id long, table_idx int, row int, col long, is_head boolean, col_span int, text string"
#: Digits before a line end, as Spark reads a number of them.
_DIGITS = re.compile(r"0*([0-9]+)(?:\r\n?|\n)?")


def _span(text: str | None) -> int:
    """A colspan that is a whole number from 1 on and fits an int, else 1."""
    found = _DIGITS.fullmatch(text or "")
    number = int(found[1]) if found and len(found[1]) <= 10 else 1
    return number if 0 < number < 1 << 31 else 1


def page_cells(source: str) -> list[list]:
    """The cells of a page's tables in document order, as in CELLS from table_idx on; texts as they stand.

    A table hands its row and column down to its cells, a text goes to the innermost cell around it.
    """
    events: list = []
    parse(source, events, counted=False)
    cells: list[list] = []
    tables: list[list[int]] = []  # those around: number, row, column, open heads
    around: list[list[str]] = []  # the texts of the cells around
    n_tables = 0
    for what, value in events:
        if what == "text":
            if around:
                around[-1].append(value)
            continue
        tag, opens = value["tag"], what == "open"
        if tag in ("td", "th"):
            if not opens:
                around.pop()
                continue
            around.append([])
            if tables:
                table = tables[-1]
                span = _span(dict(value["attrs"]).get("colspan"))
                cells.append([table[0], max(table[1], 0), table[2], table[3] > 0 or tag == "th", span, around[-1]])
                table[2] += span
        elif tag == "table":
            if opens:
                tables.append([n_tables, -1, 0, 0])
                n_tables += 1
            else:
                tables.pop()
        elif tag == "tr" and opens and tables:
            tables[-1][1] += 1
            if tables[-1][1]:
                tables[-1][2] = 0
        elif tag == "thead" and tables:
            tables[-1][3] += 1 if opens else -1
    for cell in cells:
        cell[-1] = "".join(cell[-1])
    return cells


def cell_rows(pages: DataFrame) -> DataFrame:
    """A row a table cell of pages (page_id, html), in CELLS' columns, from one parse and without a shuffle."""
    names = [x.split()[0] for x in CELLS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.string()]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        rows: list[tuple] = []
        for batch in portions(batches):
            for page_id, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(page_id, *cell) for cell in page_cells(html or "")]
                if len(rows) > MOST_ROWS:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    return spread(pages.select(F.col("page_id").cast("long"), "html")).mapInArrow(parsed, CELLS)


def _arrow_kinds() -> list[pa.DataType]:
    kinds = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.DoubleType: pa.float64()}
    return [kinds.get(type(f.dataType)) or pa.map_(pa.string(), pa.string()) for f in SCHEMA]
