"""Images of pages: source, size, source set, context and kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import fixed, urls
from webloom.runtime import checkpointed
from webloom.sources.dom import nodes


def _attr(name: str) -> Column:
    return F.trim(F.coalesce(F.col("attrs")[name], F.lit("")))


def to_int(value: Column) -> Column:
    """A number of pixels: ``120px`` and ``120`` alike; null if it is none."""
    return F.regexp_replace(F.trim(value), "[px]+$", "").try_cast("int")


def image_type(src: Column, attrs: Column, width: Column, height: Column) -> Column:
    """tracking, decorative, icon or content; the first that fits."""
    tiny = (width <= 3) & (height <= 3)
    small = F.greatest(width, height) < 48
    either = width.isNotNull() & height.isNotNull()
    return (
        F.when(F.coalesce(tiny, F.lit(False)) | src.rlike(fixed.TRACKING_SOURCE), "tracking")
        .when(F.coalesce(attrs["role"], F.lit("")) == "presentation", "decorative")
        .when(attrs["alt"] == "", "decorative")
        .when(F.coalesce(attrs["class"], F.lit("")).rlike(fixed.ICON_SOURCE) | src.rlike(fixed.ICON_SOURCE), "icon")
        .when(F.coalesce(either & small, F.lit(False)), "icon")
        .otherwise("content")
    )


def srcset(value: Column, base: Column) -> Column:
    """array<struct<url, descriptor>> of a source set."""
    parts = F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            urls.join(base, F.split(p, r"\s+")[0]).alias("url"),
            F.coalesce(F.try_element_at(F.split(p, r"\s+"), F.lit(2)), F.lit("")).alias("descriptor"),
        ),
    )


def extract_images(pages: DataFrame) -> DataFrame:
    """page_id, pos, src, alt, width, height, srcset, image_type, context, format.

    Lazy-loading sources win over ``src``; each source of a page once, the first; the
    cards of og:image and twitter:image follow as social_card.
    """
    found = checkpointed(nodes(pages, ["img", "meta", "figure", "figcaption", "p"]))
    base = F.coalesce("url", F.lit(""))
    src = F.coalesce(*[F.nullif(_attr(a), F.lit("")) for a in ("data-src", "data-lazy-src", "data-original", "src")])
    parents = found.filter("tag IN ('figure', 'p')").select(
        "page_id", F.col("nid").alias("p_nid"), F.col("tag").alias("p_tag"), F.trim(F.coalesce("text", F.lit(""))).alias("p_text")
    )
    captions = found.filter("tag = 'figcaption'").groupBy("page_id", F.col("parent").alias("c_parent")).agg(
        F.min_by(F.trim(F.coalesce("text", F.lit(""))), "nid").alias("caption")
    )
    images = (
        found.filter((F.col("tag") == "img") & src.isNotNull())
        .withColumn("src", urls.join(base, src))
        .filter(~urls.has_unsafe_scheme(F.col("src")) | F.lower("src").startswith("data:"))
        .alias("i")
        .join(parents.alias("p"), F.expr("i.page_id = p.page_id AND i.parent = p_nid"), "left")
        .join(captions.alias("c"), F.expr("i.page_id = c.page_id AND i.parent = c_parent"), "left")
    )
    width, height, alt = to_int(F.col("attrs")["width"]), to_int(F.col("attrs")["height"]), _attr("alt")
    context = (
        F.when((F.col("p_tag") == "figure") & F.col("caption").isNotNull(), F.substring("caption", 1, 200))
        .when(alt != "", alt)
        .when(F.col("p_tag") == "p", F.substring("p_text", 1, 200))
        .otherwise("")
    )
    rows = images.select(
        "i.page_id",
        F.lit(0).alias("rank"),
        "nid",
        "src",
        F.col("attrs")["alt"].alias("alt"),
        width.alias("width"),
        height.alias("height"),
        srcset(F.coalesce(F.col("attrs")["srcset"], F.lit("")), base).alias("srcset"),
        image_type(F.col("src"), F.col("attrs"), width, height).alias("image_type"),
        context.alias("context"),
    )
    named = F.coalesce(F.col("attrs")["property"], F.col("attrs")["name"])
    card = F.coalesce(F.col("attrs")["content"], F.lit(""))
    cards = found.filter((F.col("tag") == "meta") & named.isin("og:image", "twitter:image") & (card != "")).select(
        "page_id", F.lit(1).alias("rank"), "nid", urls.join(base, card).alias("src"), card.alias("alt"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.array().cast(rows.schema["srcset"].dataType).alias("srcset"), F.lit("social_card").alias("image_type"), F.lit("").alias("context"),
    )
    first = Window.partitionBy("page_id", "src").orderBy("rank", "nid")
    order = Window.partitionBy("page_id").orderBy("rank", "nid")
    ending = F.lower(F.regexp_extract(urls.path(F.col("src")), r"\.([A-Za-z0-9]+)$", 1))
    return (
        rows.unionByName(cards)
        .withColumn("nth", F.row_number().over(first))
        .filter("nth = 1")
        .withColumn("pos", F.row_number().over(order))
        .withColumn("format", F.when(ending.isin(*fixed.IMAGE_ENDINGS), ending))
        .drop("nth", "rank", "nid")
    )


def of_formats(images: DataFrame, formats: list[str]) -> DataFrame:
    """The rows of images whose ``format`` is one of formats, whatever their case; jpeg and jpg are one."""
    plain = lambda f: f.strip().lower().lstrip(".").replace("jpeg", "jpg")
    return images.filter(F.regexp_replace(F.lower("format"), "jpeg", "jpg").isin([plain(f) for f in formats]))
