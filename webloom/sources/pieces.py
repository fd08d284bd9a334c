"""Pages as rows of pieces: texts, breaks and pictures, each with where it stands.

What holds for an element holds for all it contains until something inside says otherwise, so
a start tag hands its place down and a piece takes that of the element around it. A run of
pieces that no block boundary parts has one number, ``seg``; its place is told once, with
its first piece that isn't blank. All further work on runs is DataFrame expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import fixed
from webloom.runtime import MOST_ROWS, portions, spread
from webloom.sources.dom import parse

#: Class names of parts that readers don't see, last path segments of action links.
HIDDEN = frozenset({"mw-editsection", "mw-jump-link", "sr-only", "visually-hidden", "noprint"})
_ACTION = re.compile(r"(?:^|/)(?:vote|hide|flag|upvote)\?")
_LANGUAGE = re.compile(r"(?:^|\s)(?:language-|lang-|highlight-)([\w+#.-]+)")
_UNSAFE = re.compile(rf"\s*(?:{'|'.join(fixed.UNSAFE_SCHEMES)}):", re.IGNORECASE)
HEADINGS = {f"h{i}": i for i in range(1, 7)}
#: Elements that hold blocks and what they are called; items take their first text as their own.
BOXES = {"ul": "BulletList", "ol": "OrderedList", "li": "ListItem", "blockquote": "BlockQuote", "dl": "DefinitionList", "dt": "DefinitionTerm",
         "dd": "Definition", "figure": "Figure", "figcaption": "Caption", "table": "Table", "caption": "Caption"}
ITEMS = frozenset({"ListItem", "DefinitionTerm", "Definition", "Caption"})
#: Elements whose start and end part runs.
BOUNDS = frozenset({*HEADINGS, *BOXES, "p", "pre", "td", "th", *"address article aside body div fieldset footer form header html main nav section tbody thead tfoot tr".split()})
#: Inline elements by the mark they give.
MARKS = {"strong": "strong", "b": "strong", "em": "em", "i": "em", "code": "code", "s": "del", "del": "del", "strike": "del", "sub": "sub", "sup": "sup"}

BOX = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("number", pa.int32()), ("ordered", pa.bool_()), ("depth", pa.int32())])
RUN = pa.struct([("kind", pa.string()), ("level", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("span", pa.int32()), ("head", pa.bool_()), ("boxes", pa.list_(BOX))])
PATH = pa.list_(pa.struct([("nid", pa.int32()), ("mark", pa.string()), ("href", pa.string())]))
SCHEMA = pa.schema(
    [("doc", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("seg", pa.int32()), ("pos", pa.int32()), ("raw", pa.string()), ("md", pa.string()),
     ("parted", pa.bool_()), ("path", PATH), ("language", pa.string()), ("marker", pa.bool_()), ("own", pa.bool_()), ("run", RUN)]
)
DDL = (
    "doc long, page_id long, url string, seg int, pos int, raw string, md string, parted boolean, path array<struct<nid:int,mark:string,href:string>>,"
    " language string, marker boolean, own boolean, run struct<kind:string,level:int,row:int,col:int,span:int,head:boolean,"
    "boxes:array<struct<pos:int,kind:string,number:int,ordered:boolean,depth:int>>>"
)


class _Place(NamedTuple):
    """What an element hands down. ``item`` and ``li`` are the innermost item and list item by position, ``cell`` a cell's seg."""

    hidden: bool = False
    path: tuple = ()
    boxes: tuple = ()
    kind: str = "Paragraph"
    level: int | None = None
    code: bool = False
    language: str | None = None
    item: int | None = None
    li: int | None = None
    lists: int = 0
    counter: list | None = None
    table: dict | None = None
    cell: int | None = None
    told: tuple = (None, None, None, None)


def _target(url: str | None, href: str) -> str:
    """href as an absolute URL if the page has one; an empty string if it is empty or not safe."""
    href = href.strip()
    if not href or _UNSAFE.match(href):
        return ""
    try:
        return urljoin(url or "", href)
    except ValueError:
        return href


def _number(text: str | None, least: int) -> int:
    """A whole number of digits that fits an int and isn't below the least, else 1."""
    return int(text) if text and text.isascii() and text.isdigit() and len(text) < 10 and int(text) >= least else 1


class _Runs:
    """The pieces of one page."""

    def __init__(self, url: str | None, skip: frozenset[str], root: int | None) -> None:
        self.url, self.skip, self.root = url, skip, root
        self.rows: list[tuple] = []
        self.segs = self.seg = 0
        self.parted = False
        self.told: set[int] = set()  # segs whose place is told
        self.filled: set[int] = set()  # segs with a piece that isn't blank
        self.begun: set[int] = set()  # items with a piece that isn't blank

    def cut(self, here: _Place) -> None:
        if here.cell is None:
            self.segs += 1
            self.seg = self.segs
        else:
            self.parted = True

    def add(self, pos: int, here: _Place, raw: str | None, md: str | None = None, kind: str | None = None) -> None:
        seg = self.seg if here.cell is None else here.cell
        full = bool(kind or (md or raw or "").strip())
        run, marker, own = None, False, False
        if full and seg not in self.filled:
            self.filled.add(seg)
            marker = here.li is not None and here.li not in self.begun
            own = bool(here.boxes) and here.item == here.boxes[-1][0] and here.item not in self.begun and here.kind == "Paragraph" and here.cell is None and not kind
            self.begun.update(b[0] for b in here.boxes if b[1] in ITEMS)
        if seg not in self.told and (full or here.cell is not None):
            self.told.add(seg)
            run = (kind or ("Cell" if here.cell is not None else here.kind), here.level, *here.told, list(here.boxes))
        self.rows.append((seg, pos, raw, md, self.parted and here.cell is not None, list(here.path), here.language, marker, own, run))
        self.parted = False

    def gone(self, tag: str, attrs: dict[str, str], skipped: bool) -> bool:
        return (
            skipped or tag == "head" or tag in self.skip
            or bool(attrs and (tag == "a" and _ACTION.search(attrs.get("href", "")) or HIDDEN & set(attrs.get("class", "").split())))
        )

    def opened(self, pos: int, here: _Place, row: dict) -> _Place:
        """The place inside an element."""
        tag, attrs = row["tag"], dict(row["attrs"])
        if row["nid"] == self.root:
            here = _Place()
        if here.hidden or self.gone(tag, attrs, row["skipped"]):
            return here._replace(hidden=True)
        if tag in BOUNDS:
            self.cut(here)
        in_cell = here.cell is not None
        if tag == "br":
            self.add(pos, here, "\n" if here.code else " ")
        elif tag == "hr":
            self.cut(here)
            if not in_cell:
                self.add(pos, here, None, None, "ThematicBreak")
            self.cut(here)
        elif tag == "img":
            source = _target(self.url, attrs.get("data-src") or attrs.get("src") or "")
            if source and not here.code:
                self.add(pos, here, None, f"![{' '.join(attrs.get('alt', '').split())}]({source})")
        elif tag in MARKS or tag == "a":
            if here.code:
                found = _LANGUAGE.search(attrs.get("class", "")) if tag == "code" and not here.language else None
                return here._replace(language=found[1]) if found else here
            mark, href = ("a", _target(self.url, attrs.get("href", ""))) if tag == "a" else (MARKS[tag], None)
            if href != "" and all(x[1] not in (mark, "code") for x in here.path):
                return here._replace(path=(*here.path, (row["nid"], mark, href)))
        elif tag in HEADINGS:
            return here._replace(kind="Heading", level=HEADINGS[tag])
        elif tag == "p":
            return here._replace(kind="Paragraph", level=None)
        elif tag == "pre" and not in_cell:
            found = _LANGUAGE.search(attrs.get("class", ""))
            return here._replace(kind="CodeBlock", level=None, code=True, path=(), language=attrs.get("data-lang") or (found[1] if found else None))
        elif tag in ("td", "th"):
            return self.cell(pos, here, tag, attrs)
        elif tag == "thead" and here.table:
            here.table["head"] = True
        elif tag == "tr" and here.table:
            here.table.update(row=here.table["row"] + 1, col=0)
        elif tag in BOXES:
            return self.box(pos, here, tag, attrs)
        return here

    def cell(self, pos: int, here: _Place, tag: str, attrs: dict[str, str]) -> _Place:
        if not here.table:
            return here
        self.segs += 1
        span, table = _number(attrs.get("colspan"), 1), here.table
        told = (max(table["row"], 0), table["col"], span, table["head"] or tag == "th")
        table["col"] += span
        place = here._replace(kind="Paragraph", level=None, cell=self.segs, told=told)
        self.add(pos, place, "")
        return place

    def box(self, pos: int, here: _Place, tag: str, attrs: dict[str, str]) -> _Place:
        kind, number, ordered, depth = BOXES[tag], None, None, None
        if here.cell is not None and tag != "table":
            return here  # a cell is one run
        more: dict = {}
        if tag in ("ul", "ol"):
            first = _number(attrs.get("start"), 0) if tag == "ol" else 1
            number, ordered, depth = first, tag == "ol", here.lists + 1
            more = {"lists": here.lists + 1, "counter": [tag == "ol", first - 1]}
        elif tag == "li":
            counter = here.counter or [False, 0]
            counter[1] += 1
            number, ordered, depth = counter[1], counter[0], max(here.lists, 1)
            more = {"item": pos, "li": pos}
        elif tag == "dl":
            more = {"counter": [None, 0]}
        elif tag in ("dt", "dd"):
            counter = here.counter or [None, 0]
            counter[1] += (tag == "dt" and counter[0] != "dt") or not counter[1]
            counter[0], number, more = tag, counter[1], {"item": pos}
        elif tag in ("figcaption", "caption"):
            more = {"item": pos}
        elif tag == "table":
            more = {"table": {"row": -1, "col": 0, "head": False}, "cell": None, "told": (None,) * 4, "path": () if here.cell is not None else here.path}
        return here._replace(boxes=(*here.boxes, (pos, kind, number, ordered, depth)), kind="Paragraph", level=None, **more)


def page_pieces(source: str, url: str | None, skip: frozenset[str], root: int | None = None) -> list[tuple]:
    """The pieces of a page, or of its element ``root``, from seg on, as in SCHEMA."""
    events: list = []
    parse(source, events)
    runs, stack = _Runs(url, skip, root), [_Place(hidden=root is not None)]
    for pos, (what, value) in enumerate(events):
        here = stack[-1]
        if what == "text":
            if not here.hidden:
                runs.add(pos, here, value)
        elif what == "open":
            stack.append(runs.opened(pos, here, value))
        else:
            gone = stack.pop()
            if not gone.hidden:
                if value["tag"] == "thead" and gone.table:
                    gone.table["head"] = False
                if value["tag"] in BOUNDS:
                    runs.cut(stack[-1])
    return runs.rows


def pieces(pages: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """A row a piece of pages (page_id, url, html) in DDL's columns, in order of ``pos``.

    ``doc`` numbers the rows of pages. ``path`` lists the inline elements around a piece, the outermost first: one of
    a kind, nothing inside code, and links only with a safe target. ``run`` is the place of a seg; elements named in
    ``skip`` and hidden ones are left out with all they hold. Where pages have a column ``root``, the pieces are those inside the
    element of that number; where they have ``bare``, true leaves menus and footers out, too.
    """
    left_out, more = frozenset(skip), frozenset({*skip, "nav", "footer"})

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([_column(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)

        rows: list[tuple] = []
        for batch in portions(batches):
            for doc, page_id, url, html, root, bare in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(doc, page_id, url, *row) for row in page_pieces(html or "", url, more if bare else left_out, root)]
                if len(rows) > MOST_ROWS:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    root = F.col("root").cast("int") if "root" in pages.columns else F.lit(None).cast("int").alias("root")
    bare = F.col("bare") if "bare" in pages.columns else F.lit(False).alias("bare")
    read = spread(pages.select(F.col("page_id").cast("long"), "url", "html", root, bare))
    return read.select(F.monotonically_increasing_id().alias("doc"), "page_id", "url", "html", "root", "bare").mapInArrow(parsed, DDL)


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    """Values as an Arrow array; tuples are structs."""
    return pa.array([_plain(v, kind) for v in values] if pa.types.is_nested(kind) else values, kind)


def _plain(value, kind: pa.DataType):
    if value is None:
        return None
    if pa.types.is_list(kind):
        return [_plain(v, kind.value_type) for v in value]
    return {f.name: _plain(v, f.type) if pa.types.is_nested(f.type) else v for f, v in zip(kind, value, strict=True)}
