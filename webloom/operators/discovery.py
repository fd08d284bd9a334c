"""URL discovery and breadth-first crawls over recorded pages."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.operators import patterns
from webloom.operators.links import extract_links
from webloom.runtime import checkpointed

def matches_patterns(url: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether a URL's path has a match of any include pattern and of no exclude pattern; no pattern lets all pass.

    What isn't a regular expression is left out with a warning; all other patterns hold, each matched on its own. All but
    those that look around or back are matched in linear time, however long they are; one of these that repeats a group is an error.
    """
    path, out = urls.path(url), F.lit(True)
    if inc := patterns.checked(include):
        out = out & patterns.matches(path, inc)
    if exc := patterns.checked(exclude):
        out = out & ~patterns.matches(path, exc)
    return out


def split_patterns(text: Column) -> Column:
    """Comma-separated patterns as an array without blanks."""
    return F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")


def discover_urls(
    sitemap: DataFrame,
    links: DataFrame,
    base: str,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    max_urls: int | None = None,
) -> DataFrame:
    """url, source, lastmod, link_type, depth, seq: sitemap entries (loc, lastmod, seq), then page links (url, ..., seq).

    Each URL once, the first source wins; only the base's domain and matching paths;
    the first ``max_urls`` in the order of discovery. The result is meant to be sorted
    by lastmod, newest first, then seq.
    """
    home = urls.host(F.lit(base if "://" in base else f"https://{base}"))
    entries = sitemap.select(
        F.col("loc").alias("url"), F.lit("sitemap").alias("source"), F.col("lastmod").cast("timestamp").alias("lastmod"),
        F.lit(None).cast("string").alias("link_type"), F.lit(0).alias("depth"), F.lit(0).alias("rank"), F.col("seq").cast("long").alias("seq"),
    )
    found = links.filter(F.col("is_internal") & F.col("url").rlike("^https?://")).select(
        "url", F.lit("page_link").alias("source"), F.lit(None).cast("timestamp").alias("lastmod"), "link_type",
        F.lit(1).alias("depth"), F.lit(1).alias("rank"), F.col("seq").cast("long").alias("seq"),
    )
    rows = entries.unionByName(found).filter((urls.host(F.col("url")) == home) & matches_patterns(F.col("url"), include, exclude))
    first = Window.partitionBy("url").orderBy("rank", "seq")
    once = rows.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")
    if max_urls is not None:
        once = once.orderBy("rank", "seq", "url").limit(max_urls)
    return once


def discovery_counts(found: DataFrame) -> DataFrame:
    """sitemap_count, page_link_count, total of discovered URLs."""
    return found.agg(
        F.count_if(F.col("source") == "sitemap").alias("sitemap_count"),
        F.count_if(F.col("source") == "page_link").alias("page_link_count"),
        F.count("*").alias("total"),
    )


def crawl(
    pages: DataFrame,
    start: DataFrame,
    max_depth: int = 2,
    max_pages: int | None = None,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
) -> DataFrame:
    """url, page_id, depth, status: pages (page_id, url, html) reached from start (url) over internal links.

    URLs are compared without query, fragment and trailing slash; of several pages with
    one URL that of the least page_id counts. A URL without a recorded page is an error
    row. Levels are joins against the recorded pages, cut from their lineage by
    checkpoints. With ``max_pages`` the crawl stops at so many URLs, by level and URL.
    Pages are parsed where they are read; only keys and edges are shuffled.
    """
    keyed = pages.withColumn("key", urls.crawl_key(F.col("url")))
    known = checkpointed(keyed.groupBy("key").agg(F.min("page_id").alias("page_id")))
    links = extract_links(pages.select("page_id", "url", "html")).filter("is_internal AND link_type NOT IN ('anchor')")
    edges = checkpointed(
        links.filter(F.col("url").rlike("^https?://") & matches_patterns(F.col("url"), include, exclude))
        .select("page_id", urls.crawl_key(F.col("url")).alias("to"))
        .distinct()
    )
    frontier = checkpointed(start.select(urls.crawl_key(F.col("url")).alias("key")).distinct())
    seen, levels, left = frontier, [], max_pages
    for depth in range(max_depth + 1):
        if left is not None:
            frontier = checkpointed(frontier.orderBy("key").limit(left))
            left -= frontier.count()
        level = frontier.join(known, "key", "left")
        levels.append(level.withColumn("depth", F.lit(depth)))
        if depth == max_depth or left == 0:
            break
        reached = level.join(edges, "page_id").select(F.col("to").alias("key")).distinct()
        frontier = checkpointed(reached.join(seen, "key", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select(F.col("key").alias("url"), "page_id", "depth", F.when(F.col("page_id").isNull(), "error").otherwise("crawled").alias("status"))


def crawl_summary(crawled: DataFrame) -> DataFrame:
    """Totals of a crawl."""
    return crawled.agg(
        F.count("*").alias("discovered"), F.count_if(F.col("status") == "crawled").alias("crawled"), F.count_if(F.col("status") == "error").alias("errors")
    )


def batch_outcomes(wanted: DataFrame, responses: DataFrame) -> DataFrame:
    """wanted (url) with status and error: a URL without a response is an error of its own, the others stand."""
    joined = wanted.join(responses, "url", "left")
    return joined.withColumn("error", F.when(F.col("status").isNull(), "no response").when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string"))))


def redirect_targets(redirects: DataFrame, start: DataFrame, most: int = 10) -> DataFrame:
    """url, target, hops of start (url) through redirects (source, target); more hops than ``most`` give a null target.

    ``hops`` is ``most + 1`` at most. Each round joins the table of redirects with itself and
    doubles the hops that a row stands for, so a few rounds serve chains of any start.
    """
    found = redirect_paths(redirects, start, None, most)
    return found.select("url", F.when(F.col("hops") <= most, F.col("target")).alias("target"), "hops")


def redirect_paths(redirects: DataFrame, start: DataFrame, allowed=None, most: int = 10) -> DataFrame:
    """url, target, hops, outcome, closed of start (url) through redirects (source, target).

    ``allowed`` takes a column of URLs and says which may be fetched, as ``fetch_policy.url_allowed`` does; start and every target on the way
    are held against it. Outcomes: ``ok`` at ``target``; ``closed`` if a URL may not be fetched, the first such being ``closed`` after ``hops``
    hops; ``cycle`` if the way never ends; ``too many`` beyond ``most`` hops; the last two have no target and ``most + 1`` hops. Of several
    targets of a source the least counts; a target may be relative to its source.

    Each round doubles the hops that a row stands for and carries the first closed URL over the whole way. Then only ways longer
    than ``most`` are followed on, doubling again, until they end or as many hops as there are such sources were made, which is a cycle.
    """
    may = allowed or (lambda url: F.lit(True))
    once = redirects.filter("source IS NOT NULL AND target IS NOT NULL").groupBy("source").agg(F.min("target").alias("target"))
    relative = F.col("source").rlike("^[A-Za-z][A-Za-z0-9+.-]*://")
    once = once.withColumn("target", F.when(relative, urls.join(F.col("source"), F.col("target"))).otherwise(F.col("target")))
    bad = F.when(~may(F.col("target")), F.struct(F.lit(1).alias("hop"), F.col("target").alias("at")))
    jumps = checkpointed(once.select("source", "target", F.lit(1).alias("hops"), bad.alias("bad")))

    def doubled(jumps: DataFrame, bound: int | None) -> DataFrame:
        further = jumps.select(F.col("source").alias("from_"), F.col("target").alias("to_"), F.col("hops").alias("more_"), F.col("bad").alias("bad_"))
        joined = jumps.join(further, F.col("target") == F.col("from_"), "left")
        hops = F.col("hops") + F.coalesce("more_", F.lit(0))
        later = F.when(F.col("bad_").isNotNull(), F.struct((F.col("bad_.hop") + F.col("hops")).alias("hop"), F.col("bad_.at").alias("at")))
        hops = F.least(hops, F.lit(bound)) if bound else hops
        return checkpointed(joined.select("source", F.coalesce("to_", "target").alias("target"), hops.alias("hops"), F.coalesce("bad", later).alias("bad")))

    for _ in range(math.ceil(math.log2(most + 1))):
        jumps = doubled(jumps, most + 1)
    # Sources whose way is longer: those that lead to one whose way ends are long, the others go around.
    open_ = checkpointed(jumps.filter(F.col("hops") > most).select("source", "target"))
    left, made = open_.count(), 1
    total = left
    while left and made <= total:
        ahead = open_.select(F.col("source").alias("from_"), F.col("target").alias("to_"))
        open_ = checkpointed(open_.join(ahead, F.col("target") == F.col("from_")).select("source", F.col("to_").alias("target")))
        left, made = open_.count(), made * 2
    around = open_.select("source", F.lit(True).alias("around"))
    known = jumps.join(around, "source", "left").withColumnRenamed("source", "url")
    found = start.select("url").join(known, "url", "left").withColumn("hops", F.coalesce("hops", F.lit(0)))
    own = F.when(~may(F.col("url")), F.struct(F.lit(0).alias("hop"), F.col("url").alias("at")))
    first = F.coalesce(own, F.when(F.col("bad.hop") <= most, F.col("bad")))
    found = found.withColumn("first", first)
    outcome = F.when(F.col("first").isNotNull(), "closed").when(F.col("around"), "cycle").when(F.col("hops") > most, "too many").otherwise("ok")
    return found.withColumn("outcome", outcome).select(
        "url",
        F.when(F.col("outcome") == "ok", F.coalesce("target", "url")).alias("target"),
        F.coalesce("first.hop", "hops").alias("hops"),
        "outcome",
        F.col("first.at").alias("closed"),
    )


def correlate(log: DataFrame) -> DataFrame:
    """Each response of (id, session_id, url, kind, ts, status) with the latest open request before it.

    Requests of a URL are a stack: a response closes the latest one that is open, so
    with opens as +1 and closes as -1 it is the last request whose level is the response's.
    """
    order = Window.partitionBy("session_id", "url").orderBy("ts", "id")
    up = (F.col("kind") == "request").cast("int")
    floor = F.min("raw").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = log.withColumn("raw", F.sum(2 * up - 1).over(order)).withColumn("floor", F.least(floor, F.lit(0)))
    level = F.when(F.col("kind") == "request", F.col("raw")).otherwise(F.col("raw") + 1)
    rows = rows.withColumn("level", level)
    open_ = F.last(F.when(F.col("kind") == "request", F.struct("id", "floor")), ignorenulls=True)
    paired = rows.withColumn("match", open_.over(Window.partitionBy("session_id", "url", "level").orderBy("ts", "id")))
    hit = F.col("match").isNotNull() & (F.col("match.floor") == F.col("floor"))
    return paired.filter("kind = 'response'").select("id", "session_id", "url", "status", F.when(hit, F.col("match.id")).alias("request_id"))
