"""What a fetched page shows: consent banners, rendered content, the route of its fetch, its final text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import fixed
from webloom.operators import readability
from webloom.runtime import checkpointed, grown
from webloom.sources import blocks
from webloom.sources.dom import nodes

LEAST_CONTENT, LEAST_BODY = 200, 500


def consent_managers(pages: DataFrame) -> DataFrame:
    """page_id, manager: the consent managers whose banner a page holds."""
    attrs = F.col("attrs")
    name = F.lit(None).cast("string")
    for manager, (attribute, value) in reversed(fixed.CONSENT_MANAGERS.items()):
        own = F.coalesce(attrs[attribute], F.lit(""))
        hit = F.array_contains(F.split(own, r"\s+"), value) if attribute == "class" else own == value
        name = F.when(hit, manager).otherwise(name)
    return nodes(pages).withColumn("manager", name).filter("manager IS NOT NULL").select("page_id", "manager").distinct()


def is_rendered(pages: DataFrame) -> DataFrame:
    """page_id, rendered: whether a content element has more than 200 characters, or the body more than 500."""
    attrs = F.col("attrs")
    named = attrs["id"].isin("content", "main") | F.arrays_overlap(F.split(F.coalesce(attrs["class"], F.lit("")), r"\s+"), F.array(F.lit("content"), F.lit("main")))
    content = F.col("tag").isin("main", "article") | (attrs["role"] == "main") | named
    full = (F.coalesce(content, F.lit(False)) & (F.col("stripped_len") > LEAST_CONTENT)) | ((F.col("tag") == "body") & (F.col("stripped_len") > LEAST_BODY))
    return nodes(pages).groupBy("page_id").agg(F.bool_or(full).alias("rendered"))


def is_challenge(html: Column) -> Column:
    """Whether a page is an interstitial against bots, by its first 8192 characters."""
    head, hit = F.lower(F.substring(F.coalesce(html, F.lit("")), 1, 8192)), F.lit(False)
    for mark in fixed.BOT_CHALLENGES:
        hit = hit | head.contains(mark)
    return hit


def fetch_route(status: Column, html: Column, has_browser: Column) -> Column:
    """browser where there is one; else http, and browser after a refusal or a challenge."""
    refused = status.isin(403, 406) | ((status == 200) & is_challenge(html))
    return F.when(has_browser, "browser").when(refused, "http then browser").otherwise("http")


#: A scope below this is strict.
STRICT = 0.4


def main_element(pages: DataFrame, scope: float = 0.5) -> DataFrame:
    """page_id, nid, tag, words, source: the element that a page's document is made of.

    The learned core, else the heuristic's best. A scope below 0.4 that finds no region on a page is tried
    again with 0.5. If what is found has fewer than 50 words and the
    body more than 200, the semantic container or the body is taken. Pages are parsed once.
    """
    found = checkpointed(nodes(pages))
    cores = readability.learned_regions(pages, scope, found).filter("role <> 'peer'").select("page_id", "nid", "role")
    if scope < STRICT:
        usual = readability.learned_regions(pages, 0.5, found).filter("role <> 'peer'").select("page_id", F.col("nid").alias("nid_"), F.col("role").alias("role_"))
        both, again = cores.join(grown(usual), "page_id", "full"), F.coalesce(F.col("role") == "body", F.lit(True)) & F.col("nid_").isNotNull()
        cores = both.select("page_id", F.when(again, F.col("nid_")).otherwise(F.col("nid")).alias("nid"))
    learned = cores.select("page_id", F.col("nid").alias("l_nid"))
    heuristic = readability.heuristic_regions(pages, found).filter("is_best").select("page_id", F.col("nid").alias("h_nid"))
    semantic = readability.semantic_container(pages, found=found).select("page_id", F.col("nid").alias("s_nid"))
    body = found.filter("tag = 'body'").select("page_id", F.col("nid").alias("b_nid"), F.col("words").alias("b_words"))
    chosen = body.join(grown(learned), "page_id", "left").join(grown(heuristic), "page_id", "left").join(grown(semantic), "page_id", "left")
    first = chosen.withColumn("nid", F.coalesce("l_nid", "h_nid", "b_nid")).join(grown(found.select("page_id", "nid", "words")), ["page_id", "nid"])
    thin = (F.col("words") < 50) & (F.col("b_words") > 200)
    final = F.when(thin, F.coalesce("s_nid", "b_nid")).otherwise(F.col("nid"))
    source = F.when(thin, F.when(F.col("s_nid").isNotNull(), "semantic").otherwise("body")).when(F.col("l_nid").isNotNull(), "learned").otherwise("heuristic")
    picked = first.select("page_id", final.alias("nid"), source.alias("source"))
    return picked.join(grown(found.select("page_id", "nid", "tag", "words")), ["page_id", "nid"]).select("page_id", "nid", "tag", "words", "source")


def article_blocks(pages: DataFrame, scope: float = 0.5, prose: bool = False) -> DataFrame:
    """The blocks, as of ``blocks.blocks``, of the main element of each page (page_id, url, html).

    Where that is the semantic container, the last resort before the body, menus and footers inside of it are left out. A page without
    an element has no blocks. page_id stands for one page.
    """
    main = main_element(pages, scope).select("page_id", F.col("nid").alias("root"), (F.col("source") == "semantic").alias("bare"))
    return blocks.blocks(pages.select("page_id", "url", "html").join(grown(main), "page_id"), prose=prose)
