"""Pages as trees of text blocks, with their markdown.

The parser gives a row for each text, break and picture with the inline elements and the boxes
around it. A run of them is a block: marks of emphasis and links open and close where the
inline elements of neighbouring pieces differ, so empty and repeated elements give none, white
space stays outside of them, and an inline element around blocks stands inside of each. Boxes are
lists, quotes, definitions, figures and tables; those around a run are its ancestors,
and the parent of a block is the last one opened a level above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.sources.dom import cell_rows
from webloom.sources.pieces import pieces

#: What stands before and after an inline element, by its mark; markdown has no sub and sup, so they stay HTML.
MARKS = {"strong": ("**", "**"), "em": ("*", "*"), "code": ("`", "`"), "del": ("~~", "~~"), "sub": ("<sub>", "</sub>"), "sup": ("<sup>", "</sup>"), "a": ("[", "](")}
MIME, EXTRACTOR = "text/html", "webloom"
#: White space as it is for texts: that of Unicode and four control characters.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
def _named(tag: Column, names: dict) -> Column:
    """The value of a tag in names; null if it has none."""
    out = F.lit(None)
    for name, value in names.items():
        out = F.when(tag == name, F.lit(value)).otherwise(out)
    return out


def _stripped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def _collapsed(text: Column) -> Column:
    """text with single spaces and none at its ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def _inline(rows: DataFrame) -> DataFrame:
    """A row a run: doc, page_id, url, seg, pos, raw, marked (its markdown), language, marker, own, run."""
    shown = F.coalesce("md", "raw", F.lit(""))
    piece = F.struct(
        "pos", "raw", "parted", "path", _stripped(shown).alias("core"), shown.rlike(f"^{SPACE}").alias("lead"), shown.rlike(f"{SPACE}$").alias("trail")
    )
    said = F.struct("pos", "language")
    runs = rows.withColumn("piece", piece).groupBy("doc", "page_id", "url", "seg").agg(
        F.sort_array(F.collect_list("piece")).alias("pieces"),
        F.first("run", True).alias("run"),
        F.min("pos").alias("pos"),
        F.min(F.when(F.col("language").isNotNull(), said))["language"].alias("language"),
        F.max("marker").alias("marker"),
        F.max("own").alias("own"),
    )
    raw = F.array_join(F.transform("pieces", lambda x: F.concat(F.when(x["parted"], " ").otherwise(""), F.coalesce(x["raw"], F.lit("")))), "")

    def spaced(x: Column, i: Column) -> Column:
        gap = x["parted"] | x["lead"] | ((i > 0) & F.coalesce(F.get("pieces", i - 1)["trail"], F.lit(False)))
        return F.struct(x["core"].alias("core"), x["path"].alias("path"), gap.alias("gap"))

    # A blank piece ends in white space, so a gap is seen from the piece behind it.
    full = F.filter(F.transform("pieces", spaced), lambda x: x["core"] != "")
    runs = runs.select("doc", "page_id", "url", "seg", "pos", "run", "language", "marker", "own", raw.alias("raw"), full.alias("full"))

    def differing(path: Column, other: Column) -> Column:
        return F.filter(path, lambda e: ~F.exists(F.coalesce(other, F.array().cast("array<struct<nid:int,mark:string,href:string>>")), lambda o: o["nid"] == e["nid"]))

    def joined(x: Column, i: Column) -> Column:
        opening = F.transform(differing(x["path"], F.get("full", i - 1)["path"]), lambda e: _named(e["mark"], {k: v[0] for k, v in MARKS.items()}))
        closing = F.transform(
            F.reverse(differing(x["path"], F.get("full", i + 1)["path"])),
            lambda e: F.when(e["mark"] == "a", F.concat(F.lit("]("), e["href"], F.lit(")"))).otherwise(_named(e["mark"], {k: v[1] for k, v in MARKS.items()})),
        )
        gap = F.when(x["gap"] & (i > 0), " ").otherwise("")
        core = F.regexp_replace(x["core"], f"{SPACE}+", " ")
        return F.concat(gap, F.array_join(opening, ""), core, F.array_join(closing, ""))

    return runs.withColumn("marked", F.array_join(F.transform("full", joined), "")).drop("full")


def _prefixed(found: DataFrame) -> DataFrame:
    """found with ``md`` behind what its boxes put before its lines: quotes, the marker of an item, or its indentation."""
    li = F.element_at(F.concat(F.array(F.lit(-1)), F.transform(F.filter("boxes", lambda b: b["kind"] == "ListItem"), lambda b: b["pos"])), -1)
    mark = lambda b: F.when(b["ordered"], F.concat(b["number"].cast("string"), F.lit(". "))).otherwise("- ")

    def before(first: bool):
        own = lambda b: F.when(F.lit(first) & F.col("marker") & (b["pos"] == li), mark(b)).otherwise("  ")
        return F.array_join(F.transform("boxes", lambda b: F.when(b["kind"] == "BlockQuote", "> ").when(b["kind"] == "ListItem", own(b)).otherwise("")), "")

    found = found.withColumn("first", before(True)).withColumn("rest", before(False))
    lines = F.array_join(F.transform(F.split("md", "\n"), lambda x: F.concat("rest", x)), "\n")
    md = F.when(F.col("md") == "", "").when(F.instr("md", "\n") == 0, F.concat("first", "md")).otherwise(F.concat("first", F.substring(lines, F.char_length("rest") + 1, F.char_length(lines))))
    return found.withColumn("md", md).drop("first", "rest")


def _with_tables(runs: DataFrame) -> DataFrame:
    """Rows of runs (pos, cell, leaf, boxes, marker, own) with the cells of a table as one row, its leaf a table."""
    is_cell, box = F.col("cell").isNotNull(), F.element_at("boxes", -1)
    at = F.when(is_cell, box["pos"]).otherwise(F.col("pos"))
    found = runs.groupBy("doc", "page_id", "url", at.alias("pos")).agg(
        F.sort_array(F.collect_list("cell")).alias("cells"),
        F.max("leaf").alias("leaf"),
        F.first(F.when(is_cell, F.slice("boxes", F.lit(1), F.size("boxes") - 1)).otherwise(F.col("boxes"))).alias("boxes"),
        F.max("marker").alias("marker"),
        F.max("own").alias("own"),
    )
    found = found.filter(F.col("leaf").isNotNull() | F.exists("cells", lambda c: c["md"] != ""))
    numbers = F.array_distinct(F.transform("cells", lambda c: c["row"]))
    found = found.withColumn("rows", F.transform(numbers, lambda n: F.filter("cells", lambda c: c["row"] == n)))
    found = found.withColumn("width", F.array_max(F.transform("rows", lambda r: F.aggregate(r, F.lit(0), lambda a, c: a + c["span"]))))
    spanned = lambda r: F.flatten(F.transform(r, lambda c: F.concat(F.array(c["md"]), F.array_repeat(F.lit(""), c["span"] - 1))))
    filled = lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(F.col("width") - F.size(r), F.lit(0))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(filled(spanned(r)), " | "), F.lit(" |"))
    ruled = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("width")))
    empty = F.concat(F.lit("|"), F.repeat(F.lit("  |"), F.col("width")))
    head, lines = F.forall(F.get("rows", F.lit(0)), lambda c: c["head"]), F.transform("rows", line)
    md = F.when(head, F.concat(F.slice(lines, 1, 1), F.array(ruled), F.slice(lines, F.lit(2), F.size(lines)))).otherwise(F.concat(F.array(empty, ruled), lines))
    plain = F.array_join(F.transform("rows", lambda r: F.array_join(F.transform(r, lambda c: c["text"]), " | ")), "\n")
    null = F.lit(None)
    told = F.struct(F.lit("Table").alias("node_type"), null.cast("int").alias("level"), plain.alias("text"), F.array_join(md, "\n").alias("md"), null.cast("string").alias("language"))
    return found.withColumn("leaf", F.coalesce("leaf", told)).select("doc", "page_id", "url", "pos", "leaf.*", "boxes", "marker", "own")


def looks_like_ixbrl(html: Column) -> Column:
    """Whether a page is an inline XBRL report."""
    return F.coalesce(html.rlike(r"(?i)<ix:[a-z]|\sxmlns:ix\s*="), F.lit(False))


def without_ixbrl(html: Column) -> Column:
    """A page without the header of inline XBRL; of its other tags only what they hold is left."""
    body = F.regexp_replace(html, r"(?is)<ix:header\b.*?</ix:header\s*>", "")
    return F.regexp_replace(body, r"(?i)</?ix:[a-z][^<>]*>", "")


def blocks(pages: DataFrame, skip: tuple[str, ...] = (), prose: bool = False, ixbrl: bool | None = None) -> DataFrame:
    """A row a block: page_id, block_idx, parent_idx, node_type, depth, list_type, number, text, md, language, uri, mime_type, extractor.

    ``block_idx`` numbers blocks in the order of the page and ``parent_idx`` is the number of the block around one. Lists,
    quotes, definition lists, figures and items that begin with another block have rows without text of their own; those
    without any content have none. ``depth`` is a heading's level or the number of lists around an item, ``number`` an
    item's number, a list's first, or that of a group of terms and definitions. A table is one block of its cells' texts, its
    caption and tables inside of its cells are blocks below it. Links and pictures have absolute targets if the page has
    a URL; of a link that isn't safe the text is left. Elements named in ``skip`` are left out with all they hold. With
    ``prose`` a pre holds paragraphs with blank lines between them instead of code. The tags of inline XBRL go if ``ixbrl`` is true,
    or if it is null and a page has them. A page that stands twice gives its blocks twice; a null or empty one gives none.
    """
    if ixbrl is not False:
        html = F.col("html")
        pages = pages.withColumn("html", F.when(F.lit(True) if ixbrl else looks_like_ixbrl(html), without_ixbrl(html)).otherwise(html))
    runs = _inline(pieces(pages, skip).repartition("doc")).filter("run IS NOT NULL")
    kind, level, raw = F.col("run.kind"), F.col("run.level"), F.col("raw")
    is_code, is_cell = kind == "CodeBlock", kind == "Cell"
    runs = runs.withColumn("text", F.when(is_code, F.regexp_replace(raw, r"^\n+|\n+$", "")).otherwise(_collapsed(raw)))
    runs = runs.filter(is_cell | (_stripped(F.col("text")) != "") | (F.col("marked") != "") | (kind == "ThematicBreak"))
    md = (
        F.when(kind == "Heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), "marked"))
        .when(is_code, F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), "text", F.lit("\n```")))
        .when(kind == "ThematicBreak", "---")
        .otherwise(F.col("marked"))
    )
    leaf = F.struct(kind.alias("node_type"), level.alias("level"), "text", md.alias("md"), F.when(is_code, F.col("language")).alias("language"))
    cell = F.struct("run.row", "run.col", "run.span", "run.head", F.regexp_replace("marked", r"\|", r"\\|").alias("md"), "text")
    found = _with_tables(runs.select("*", "run.boxes", F.when(~is_cell, leaf).alias("leaf"), F.when(is_cell, cell).alias("cell"))).withColumn("nth", F.lit(0))
    if prose:
        is_code = F.col("node_type") == "CodeBlock"
        part = F.filter(F.transform(F.split("text", rf"\n(?:{SPACE}*\n)+"), _collapsed), lambda p: p != "")
        parts = found.drop("nth").select("*", F.posexplode(F.when(is_code, part).otherwise(F.array("text"))).alias("nth", "part"))
        shown = {"text": F.col("part"), "md": F.when(is_code, F.col("part")).otherwise(F.col("md")), "language": F.lit(None).cast("string")}
        found = parts.withColumns({**shown, "node_type": F.when(is_code, "Paragraph").otherwise(F.col("node_type")), "marker": F.col("marker") & (F.col("nth") == 0)})
    found = _prefixed(found)
    # The first text of an item is the item's; boxes around blocks are blocks, too.
    last = F.element_at(F.concat(F.array(F.lit(None).cast(found.schema["boxes"].dataType.elementType)), "boxes"), -1)
    above = F.when(F.col("own"), F.slice("boxes", F.lit(1), F.size("boxes") - 1)).otherwise(F.col("boxes"))
    own = F.struct(
        F.lit(1).alias("real"), F.size(above).alias("up"), F.when(F.col("own"), last["kind"]).otherwise(F.col("node_type")).alias("node_type"),
        F.when(F.col("own"), last["depth"]).otherwise(F.col("level")).alias("depth"), F.when(F.col("own"), last["ordered"]).alias("ordered"),
        F.when(F.col("own"), last["number"]).alias("number"), "text", "md", "language",
        F.when(F.col("own"), last["pos"]).otherwise(F.col("pos")).alias("pos"), "nth",
    )
    null = F.lit(None).cast("string")
    box = lambda b, i: F.struct(
        F.lit(0).alias("real"), i.alias("up"), b["kind"].alias("node_type"), F.when(b["kind"] == "ListItem", b["depth"]).alias("depth"),
        b["ordered"].alias("ordered"), b["number"].alias("number"), F.lit("").alias("text"), F.lit("").alias("md"), null.alias("language"),
        b["pos"].alias("pos"), F.lit(0).alias("nth"),
    )
    each = found.select("doc", "page_id", "url", F.explode(F.concat(F.array(own), F.transform("boxes", box))).alias("b"))
    rows = each.groupBy("doc", "page_id", "url", F.col("b.pos").alias("pos"), F.col("b.nth").alias("nth")).agg(F.max("b").alias("b"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("pos", "nth")) - 1
    rows = rows.withColumn("block_idx", place).select("doc", "page_id", "url", "block_idx", "b.*")
    # Each row stands at its level, where it asks for its parent, and a level below, where it may be one.
    asked = rows.withColumn("asks", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("level", F.when(F.col("asks"), F.col("up")).otherwise(F.col("up") + 1))
    opened = F.last(F.when(~F.col("asks"), F.col("block_idx")), True).over(Window.partitionBy("doc", "level").orderBy("block_idx", "asks").rowsBetween(Window.unboundedPreceding, 0))
    listed = F.col("node_type").isin("ListItem", "BulletList", "OrderedList")
    return asked.withColumn("parent", opened).filter("asks").select(
        "page_id", "block_idx", F.when(F.col("up") > 0, F.col("parent")).alias("parent_idx"), "node_type", "depth",
        F.when(listed, F.when(F.col("ordered"), "ordered").otherwise("bullet")).alias("list_type"), "number", "text", "md", "language",
        F.col("url").alias("uri"), F.lit(MIME).alias("mime_type"), F.lit(EXTRACTOR).alias("extractor"),
    )


def cells(pages: DataFrame) -> DataFrame:
    """A row a table cell: page_id, table_idx, row, col, is_head, col_span, text.

    A row is a head row if it stands in thead; a th is a head cell anywhere. The text of a
    cell that holds a table is what stands outside of that table's cells.
    """
    return cell_rows(pages).select("page_id", "table_idx", "row", F.col("col").cast("int").alias("col"), "is_head", "col_span", _collapsed(F.col("text")).alias("text"))


def documents(found: DataFrame) -> DataFrame:
    """page_id, text, markdown: blocks joined by blank lines, in order."""
    both = F.array_sort(F.collect_list(F.struct("block_idx", "text", "md")))
    joined = lambda f: F.array_join(F.filter(F.transform("b", lambda x: x[f]), lambda t: t != ""), "\n\n")
    return found.groupBy("page_id").agg(both.alias("b")).select("page_id", joined("text").alias("text"), joined("md").alias("markdown"))


def column_types(found: DataFrame) -> DataFrame:
    """page_id, table_idx, col, name, type: the narrowest of integer, float and text that fits all body cells."""
    text = F.col("text")
    body = (F.col("row") > 0) & (text != "")
    fits = lambda kind: F.count_if(body & text.try_cast(kind).isNotNull())
    # Cells are counted beside their heads first, where nothing is sorted; a column has few rows then.
    column = ["page_id", "table_idx", "col"]
    counted = found.groupBy(*column, F.when(F.col("row") == 0, text).alias("head")).agg(
        F.count_if(body).alias("n"), fits("bigint").alias("ints"), fits("double").alias("floats")
    )
    counted = counted.groupBy(*column).agg(F.max("head").alias("name"), *[F.sum(c).alias(c) for c in ("n", "ints", "floats")]).filter("n > 0")
    kind: Column = F.when(F.col("ints") == F.col("n"), "integer").when(F.col("floats") == F.col("n"), "float").otherwise("text")
    return counted.select("page_id", "table_idx", "col", "name", kind.alias("type"))
