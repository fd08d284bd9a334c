"""Links of pages, classified by what they are and where they stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import fixed, urls
from webloom.sources.dom import nodes


def link_type(url: Column, text: Column, rel: Column, position: Column, href: Column) -> Column:
    """anchor, pagination, social, download, navigation or content; the first that fits."""
    file = F.lower(urls.path(url))
    download = F.lit(False)
    for ending in fixed.DOWNLOAD_ENDINGS:
        download = download | file.endswith(ending)
    paged = F.arrays_overlap(F.split(rel, r"\s+"), F.array(F.lit("next"), F.lit("prev")))
    return (
        F.when(href.startswith("#"), "anchor")
        .when(F.coalesce(paged, F.lit(False)), "pagination")
        .when((position == "nav") & text.rlike(fixed.PAGINATION_TEXT), "pagination")
        .when(urls.host(url).isin(*fixed.SOCIAL_HOSTS), "social")
        .when(download, "download")
        .when(position.isin("nav", "header", "footer"), "navigation")
        .otherwise("content")
    )


def extract_links(pages: DataFrame) -> DataFrame:
    """page_id, pos, url, text, title, rel, is_internal, link_type, position.

    Links in document order, each resolved URL of a page once, the first of them; then
    the page's ``<link rel=next|prev>``. Unsafe schemes and empty references are left
    out. A link without text takes the alternative text of its first image.
    """
    found = nodes(pages, ["a", "link", "img"])
    href = F.col("attrs")["href"]
    known = found.withColumn("href", href).withColumn("host", urls.host(F.coalesce("url", F.lit(""))))
    image = Window.partitionBy("page_id").orderBy("nid").rowsBetween(Window.currentRow + 1, Window.unboundedFollowing)
    images = F.min(F.when(F.col("tag") == "img", F.struct("nid", F.trim(F.coalesce(F.col("attrs")["alt"], F.lit(""))).alias("alt"))))
    known = known.withColumn("image", images.over(image))
    rel = F.lower(F.trim(F.coalesce(F.col("attrs")["rel"], F.lit(""))))
    is_a = F.col("tag") == "a"
    rows = known.filter(
        (F.coalesce("href", F.lit("")) != "")
        & F.when(is_a, ~urls.has_unsafe_scheme(F.col("href"))).otherwise((F.col("tag") == "link") & rel.isin("next", "prev"))
    )
    kept_as_is = is_a & F.col("href").rlike("^(#|mailto:|tel:)")
    base = F.coalesce("url", F.lit(""))
    resolved = F.when((base == "") | kept_as_is, F.col("href")).otherwise(urls.join(base, F.col("href")))
    text = F.trim(F.coalesce("text", F.lit("")))
    inner = F.when(F.col("image")["nid"] <= F.col("last_desc"), F.col("image")["alt"]).otherwise("")
    rows = rows.select(
        "page_id",
        "nid",
        "host",
        "href",
        is_a.alias("is_a"),
        resolved.alias("link_url"),
        F.when(is_a, F.when(text != "", text).otherwise(F.coalesce(inner, F.lit("")))).otherwise(rel).alias("text"),
        F.col("attrs")["title"].alias("title"),
        rel.alias("rel"),
        F.when(is_a, F.col("position")).otherwise("header").alias("position"),
    )
    # The links of a page come first, its <link> elements last.
    first = Window.partitionBy("page_id", "link_url").orderBy(F.desc("is_a"), "nid")
    order = Window.partitionBy("page_id").orderBy(F.desc("is_a"), "nid")
    rows = rows.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    kind = link_type(F.col("link_url"), F.col("text"), F.col("rel"), F.col("position"), F.col("href"))
    return rows.select(
        "page_id",
        F.row_number().over(order).alias("pos"),
        F.col("link_url").alias("url"),
        "text",
        "title",
        "rel",
        urls.is_internal(F.col("link_url"), F.col("host")).alias("is_internal"),
        F.when(F.col("is_a"), kind).otherwise("pagination").alias("link_type"),
        "position",
    )


def filter_links(links: DataFrame, link_type: str | None = None, internal_only: bool = False) -> DataFrame:
    """Links of one type, or internal ones only."""
    kept = links.filter(F.col("link_type") == link_type) if link_type else links
    return kept.filter("is_internal") if internal_only else kept
