"""Feeds and sitemaps: tolerant XML reading into rows."""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.markup import attributes, decoded, scan
from webloom.runtime import MOST_ROWS, checkpointed, portions, spread

#: Items of a feed and characters of a description that a bounded reading keeps.
MOST_ITEMS, MOST_DESCRIPTION = 1000, 2000
ITEMS = (
    "feed_id long, format string, feed_title string, feed_link string, item int, title string, link string,"
    " date_text string, description string, author string, guid string, categories array<string>"
)


class Node:
    """An XML element: local name, attributes, text of its own and children."""

    __slots__ = ("name", "attrs", "text", "children")

    def __init__(self, name: str, attrs: dict[str, str]) -> None:
        self.name, self.attrs, self.text, self.children = name, attrs, "", []

    def first(self, *names: str) -> Node | None:
        return next((c for c in self.children if c.name in names), None)

    def value(self, *names: str) -> str | None:
        found = self.first(*names)
        return (found.text.strip() or None) if found else None


def read_xml(body: str) -> Node:
    """The tree of an XML text, however broken: what is open at the end is closed.

    Names lose their prefix. Only the references of HTML are decoded; entities that the
    document declares are never expanded.
    """
    top = Node("", {})
    stack = [top]
    for kind, name, attrs in scan(body, raw_text=False):
        if kind in ("text", "cdata"):
            stack[-1].text += decoded(name) if kind == "text" else name
        elif kind == "close":
            local = name.rpartition(":")[2]
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == local), 0)
            if at:
                del stack[at:]
        else:
            node = Node(name.rpartition(":")[2], {k.rpartition(":")[2]: v for k, v in attributes(attrs).items()})
            stack[-1].children.append(node)
            if kind == "open":
                stack.append(node)
    return top


def _atom_link(node: Node) -> str | None:
    other = None
    for link in (c for c in node.children if c.name == "link" and c.attrs.get("href")):
        rel = link.attrs.get("rel", "alternate")
        if rel == "alternate":
            return link.attrs["href"]
        other = other or (link.attrs["href"] if rel != "self" else None)
    return other


def feed_rows(body: str, most: int | None = MOST_ITEMS, longest: int | None = MOST_DESCRIPTION) -> tuple[dict, list[dict]]:
    """A feed's own fields and its items; format ``unknown`` and no items if it is no feed.

    The first ``most`` items are kept and descriptions cut to ``longest`` characters; None keeps all.
    """
    top = read_xml(body)
    root = next((c for c in top.children if c.name in ("rss", "feed", "RDF")), None)
    if root is not None and root.name == "feed":
        head = {"format": "atom", "feed_title": root.value("title"), "feed_link": _atom_link(root)}
        entries = [c for c in root.children if c.name == "entry"]
    else:
        channel = (root or (top.children[0] if top.children else top)).first("channel")
        if channel is None:
            return {"format": "unknown"}, []
        head = {"format": "rss", "feed_title": channel.value("title"), "feed_link": channel.value("link")}
        entries = [c for c in channel.children if c.name == "item"]
    items = []
    for entry in entries:
        if len(items) == most:
            break
        if head["format"] == "atom":
            person = entry.first("author")
            item = {"link": _atom_link(entry) or "", "description": entry.value("summary", "content"), "guid": entry.value("id")}
            item |= {"author": person.value("name") if person else None, "date_text": entry.value("published", "updated")}
            labels = [c.attrs.get("term", "") for c in entry.children if c.name == "category"]
        else:
            guid = entry.first("guid")
            link = entry.value("link") or ""
            if not link and guid is not None and guid.attrs.get("ispermalink", "true").lower() == "true":
                link = guid.text.strip()
            item = {"link": link, "description": entry.value("description"), "guid": entry.value("guid")}
            item |= {"author": entry.value("author", "creator"), "date_text": entry.value("pubDate", "date")}
            labels = [c.text.strip() for c in entry.children if c.name == "category"]
        item |= {"title": entry.value("title") or "", "categories": [x for x in labels if x]}
        if item["title"] or item["link"]:
            text = item["description"]
            if text and longest is not None and len(text) > longest:
                item["description"] = text[:longest] + "…"
            items.append(item | {"item": len(items) + 1})
    return head, items


def parse_feeds(docs: DataFrame, most: int | None = None, longest: int | None = None) -> DataFrame:
    """One row an item of each feed of (feed_id, body); a feed without items has one row without item.

    Everything is kept unless ``most`` bounds the items of a feed (MOST_ITEMS is usual) and
    ``longest`` the characters of a description (MOST_DESCRIPTION).
    """
    names = [x.split()[0] for x in ITEMS.split(", ")]
    kinds = {"feed_id": pa.int64(), "item": pa.int32(), "categories": pa.list_(pa.string())}

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names], names)

        rows: list[dict] = []
        for batch in portions(batches):
            for feed_id, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                head, items = feed_rows(body or "", most, longest)
                rows += [{"feed_id": feed_id} | head | item for item in items or [{}]]
                if len(rows) > MOST_ROWS:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    return spread(docs.select(F.col("feed_id").cast("long"), "body")).mapInArrow(parsed, ITEMS).withColumn(
        "published", feed_date(F.col("date_text"))
    )


def feed_date(text: Column) -> Column:
    """An RFC 822 date, else an ISO one, else null."""
    plain = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    mail = plain.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d\d:\d\d:\d\d [+-]\d{4}$")
    named = plain.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d\d:\d\d:\d\d (GMT|UTC|Z)$")
    return F.coalesce(
        F.when(mail, F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z"))),
        F.when(named, F.try_to_timestamp(F.regexp_replace(plain, "(GMT|UTC|Z)$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z"))),
        F.when(plain.rlike(r"^\d{4}-\d\d-\d\d([T ]|$)"), plain.try_cast("timestamp")),
    )


def sitemap_date(text: Column) -> Column:
    """A lastmod: an ISO time, or a date cut after the day, month or year."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{4}(-\d\d(-\d\d([T ].*)?)?)?$"), t.try_cast("timestamp"))


def sitemap_priority(text: Column) -> Column:
    value = F.trim(text).try_cast("double")
    return F.when(value.between(0.0, 1.0), value)


def bounded_gunzip(body: bytes, most: int) -> bytes:
    """body unpacked, or as it is if it isn't packed; more than ``most`` bytes is an error."""
    if body[:2] != b"\x1f\x8b":
        return body
    out = gzip.GzipFile(fileobj=io.BytesIO(body)).read(most + 1)
    if len(out) > most:
        raise ValueError(f"more than {most} bytes unpacked")
    return out


def gunzipped(files: DataFrame, most: int = 50 << 20) -> DataFrame:
    """(url, body, error) of (url, packed): files that can't be unpacked within the bound have an error."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 8):
            bodies, errors = [], []
            for packed in batch.column("packed").to_pylist():
                try:
                    bodies.append(bounded_gunzip(packed or b"", most).decode("utf-8", "replace"))
                    errors.append(None)
                except (OSError, EOFError, ValueError, zlib.error) as e:
                    bodies.append(None)
                    errors.append(type(e).__name__)
            yield pa.RecordBatch.from_arrays(
                [batch.column("url"), pa.array(bodies, pa.string()), pa.array(errors, pa.string())], ["url", "body", "error"]
            )

    return files.select("url", "packed").mapInArrow(unpack, "url string, body string, error string")


def _inner(entry: Column, name: str) -> Column:
    raw = F.regexp_extract(entry, rf"(?is)<(?:\w+:)?{name}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{name}\s*>", 1)
    text = F.trim(F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))
    for reference, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(reference), F.lit(plain))
    return F.nullif(text, F.lit(""))


def sitemap_entries(files: DataFrame) -> DataFrame:
    """url (of the file), is_index, loc, lastmod, changefreq, priority of (url, body): XML or one URL a line.

    A truncated file keeps its complete entries.
    """
    body = F.coalesce("body", F.lit(""))
    xml = F.ltrim(body).startswith("<")
    index = body.rlike(r"(?i)<(\w+:)?sitemapindex[\s>]")
    tag = F.when(index, "sitemap").otherwise("url")
    pattern = F.concat(F.lit(r"(?is)<(?:\w+:)?"), tag, F.lit(r"(?:\s[^>]*)?>(.*?)</(?:\w+:)?"), tag, F.lit(r"\s*>"))
    lines = F.filter(F.transform(F.split(body, "\r\n|[\r\n]"), lambda x: F.trim(x)), lambda x: x.rlike("^https?://"))
    listed = F.transform(lines, lambda x: F.concat(F.lit("<loc>"), F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("</loc>")))
    # What is told of a file is told below its entries: beside them it would be told again, from the whole body, for each one.
    told = files.select("url", (xml & index).alias("is_index"), F.when(xml, F.regexp_extract_all(body, pattern, F.lit(1))).otherwise(listed).alias("es"))
    rows = told.select("url", "is_index", F.explode("es").alias("e"))
    entry = F.col("e")
    return rows.select(
        "url", "is_index", _inner(entry, "loc").alias("loc"), sitemap_date(_inner(entry, "lastmod")).alias("lastmod"),
        _inner(entry, "changefreq").alias("changefreq"), sitemap_priority(_inner(entry, "priority")).alias("priority"),
    ).filter("loc IS NOT NULL")


def resolve_sitemaps(files: DataFrame, start: DataFrame, max_depth: int = 3) -> DataFrame:
    """Entries reached from the start files (url) through sitemap indexes, each file once.

    Files are parsed once. One join a level, ``max_depth`` levels at most; a file that was
    seen is not read again. Levels are cut from their lineage by checkpoints.
    """
    entries = checkpointed(sitemap_entries(files))
    frontier = checkpointed(start.select("url").distinct().withColumn("depth", F.lit(0)))
    reached = frontier
    for depth in range(max_depth):
        nested = frontier.join(entries.filter("is_index"), "url").select(F.col("loc").alias("url")).distinct()
        frontier = checkpointed(nested.join(reached, "url", "left_anti").withColumn("depth", F.lit(depth + 1)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached.join(entries.filter(~F.col("is_index")).drop("is_index"), "url")


def sitemap_tree(files: DataFrame, start: DataFrame, max_depth: int = 3, most: int = 50 << 20) -> tuple[DataFrame, DataFrame]:
    """What is reached from the start files (url) through files (url, packed): entries, and every visit with its error.

    Entries are those of ``sitemap_entries`` with the depth of their file. Visits are (url, parent, depth, error, n): a row for each start and each line
    of an index that was read, with the file's number of entries or nested files. Errors: ``missing`` (no such file), ``empty``, ``too large``
    (more than ``most`` bytes, packed or not), ``broken`` (can't be unpacked), ``too deep`` (below ``max_depth``), ``again`` (visited before on this way
    or another, as in a cycle; such a file isn't read twice). Levels are visited in turn; in a level the least parent visits first. Packed or plain is told
    by a file's first bytes; of files that stand twice one counts. Each file is unpacked and parsed once, each level is one join, cut from its lineage.
    """
    sized = files.filter("url IS NOT NULL").groupBy("url").agg(F.max("packed").alias("packed"))
    large = F.octet_length("packed") > most
    small = gunzipped(sized.filter(~F.coalesce(large, F.lit(False))), most)
    error = F.when(F.col("error") == "ValueError", "too large").when(F.col("error").isNotNull(), "broken").when(~F.coalesce("body", F.lit("")).rlike(r"\S"), "empty")
    read = checkpointed(small.withColumn("error", error).unionByName(sized.filter(large).select("url", F.lit(None).cast("string").alias("body"), F.lit("too large").alias("error"))))
    parsed = checkpointed(sitemap_entries(read.filter("error IS NULL")))
    counts = parsed.groupBy("url").agg(F.count("*").alias("n"))
    known = read.select("url", F.lit(True).alias("there"), F.col("error").alias("unread"))
    root = start.select("url", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"))
    asked, reached, visits = checkpointed(root), None, []
    first = Window.partitionBy("url").orderBy("parent")
    while True:
        ranked = asked.withColumn("nth", F.row_number().over(first))
        if reached is not None:
            ranked = ranked.join(reached.withColumn("before", F.lit(True)), "url", "left")
        else:
            ranked = ranked.withColumn("before", F.lit(None).cast("boolean"))
        again, deep = F.col("before").isNotNull() | (F.col("nth") > 1), F.col("depth") > max_depth
        told = ranked.join(known, "url", "left").withColumn(
            "error", F.when(again, "again").when(deep, "too deep").when(F.col("there").isNull(), "missing").otherwise(F.col("unread"))
        )
        level = checkpointed(told.select("url", "parent", "depth", "error"))
        visits.append(level)
        new = level.filter("error IS NULL OR error <> 'again'").select("url")
        reached = new if reached is None else reached.unionByName(new)
        nested = level.filter("error IS NULL").join(parsed.filter("is_index"), "url")
        asked = checkpointed(nested.select(F.col("loc").alias("url"), F.col("url").alias("parent"), (F.col("depth") + 1).alias("depth")))
        if asked.isEmpty():
            break
    every = visits[0]
    for level in visits[1:]:
        every = every.unionByName(level)
    entries = every.filter("error IS NULL").select("url", "depth").join(parsed.filter(~F.col("is_index")).drop("is_index"), "url")
    out = every.join(counts, "url", "left").select("url", "parent", "depth", "error", F.when(F.col("error").isNull(), F.coalesce("n", F.lit(0))).alias("n"))
    return entries, out


#: Where a sitemap is looked for if robots.txt names none, in this order.
WELL_KNOWN = ("/sitemap.xml", "/sitemap_index.xml")


def discover_sitemaps(domains: DataFrame, robots: DataFrame, files: DataFrame) -> DataFrame:
    """domain, pos, url, source of the sitemaps of domains (domain): names or base URLs.

    They are the Sitemap lines of robots (host, body) in their order, else the first well-known
    place that files (url, body) have with a body that isn't blank.
    """
    named = F.col("domain").rlike("^https?://")
    base = F.when(named, F.regexp_extract("domain", r"^(https?://[^/?#]*)", 1)).otherwise(F.concat(F.lit("https://"), "domain"))
    asked = domains.select("domain").distinct().withColumn("base", base)
    asked = asked.withColumn("host", F.lower(F.regexp_replace("base", "^https?://", "")))
    lines = robots.select(F.lower("host").alias("host"), F.posexplode(F.split("body", "\r\n|[\r\n]")).alias("pos", "line"))
    place = F.trim(F.regexp_extract(F.regexp_replace("line", "#.*$", ""), r"(?i)^\s*sitemap\s*:(.*)$", 1))
    listed = lines.select("host", "pos", place.alias("url")).filter("url <> ''")
    by_robots = asked.join(listed, "host").select("domain", "pos", "url", F.lit("robots").alias("source"))
    tried = asked.join(listed, "host", "left_anti").select(
        "domain", "base", F.posexplode(F.array(*map(F.lit, WELL_KNOWN))).alias("pos", "path")
    )
    there = files.filter(F.trim(F.coalesce("body", F.lit(""))) != "").select("url").distinct()
    hits = tried.withColumn("url", F.concat("base", "path")).join(there, "url")
    first = hits.groupBy("domain").agg(F.min(F.struct("pos", "url")).alias("first"))
    return by_robots.unionByName(first.select("domain", "first.pos", "first.url", F.lit("well-known").alias("source")))
