"""Recorded answers of web search services as rows (query_id, position, title, url, snippet, source)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.markup import attributes, decoded, scan

MOST_BRAVE = 20


def _items(answers: DataFrame, path: str) -> DataFrame:
    parsed = answers.select("query_id", F.try_parse_json("body").alias("v"))
    return parsed.select("query_id", "v", F.posexplode(F.try_variant_get("v", path, "array<variant>")).alias("n", "item"))


def _get(path: str, item: str = "item") -> Column:
    return F.coalesce(F.try_variant_get(item, path, "string"), F.lit(""))


def _shaped(rows: DataFrame, position: Column, title: str, url: str, snippet: Column, source: str, most: int) -> DataFrame:
    out = rows.select("query_id", position.cast("int").alias("position"), _get(title).alias("title"), _get(url).alias("url"), snippet.alias("snippet"), F.lit(source).alias("source"))
    order = Window.partitionBy("query_id").orderBy("position", "url")
    return out.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).drop("n")


def serpapi(answers: DataFrame, most: int = 10) -> DataFrame:
    """Organic results, an answer box before them at position 0."""
    rows = _items(answers, "$.organic_results")
    position = F.coalesce(F.try_variant_get("item", "$.position", "int"), F.col("n") + 1)
    organic = _shaped(rows, position, "$.title", "$.link", _get("$.snippet"), "serpapi", most)
    box = answers.select("query_id", F.try_variant_get(F.try_parse_json("body"), "$.answer_box", "variant").alias("item")).filter("item IS NOT NULL")
    snippet = F.coalesce(F.try_variant_get("item", "$.snippet", "string"), F.try_variant_get("item", "$.answer", "string"), F.lit(""))
    boxes = _shaped(box, F.lit(0), "$.title", "$.link", snippet, "serpapi", 1)
    order = Window.partitionBy("query_id").orderBy("position", "url")
    return organic.unionByName(boxes).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).drop("n")


def exa(answers: DataFrame, most: int = 10) -> DataFrame:
    """Results whose snippet is their first highlight."""
    return _shaped(_items(answers, "$.results"), F.col("n") + 1, "$.title", "$.url", _get("$.highlights[0]"), "exa", most)


def brave(answers: DataFrame, most: int = 10) -> DataFrame:
    """Web results, MOST_BRAVE at most."""
    return _shaped(_items(answers, "$.web.results"), F.col("n") + 1, "$.title", "$.url", _get("$.description"), "brave", min(most, MOST_BRAVE))


def _scraped(body: str, most: int) -> list[tuple[str, str, str]]:
    """title, url, snippet of the result blocks of a results page, each URL once."""
    out: list[list[str]] = []
    depth = inside = 0
    part = -1
    for kind, name, attrs in scan(body):
        tag = name.lower()
        if kind == "text":
            if part >= 0 and out:
                out[-1][part] += decoded(name)
        elif tag == "div":
            depth += 1 if kind == "open" else -1 if kind == "close" else 0
            if kind == "open" and not inside and "result" in attributes(attrs).get("class", ""):
                inside = depth
            elif kind == "close" and depth < inside:
                inside, part = 0, -1
        elif inside and kind == "open":
            found = attributes(attrs)
            if tag == "a" and "result__a" in found.get("class", "").split():
                out.append(["", found.get("href", ""), ""])
                part = 0
            elif "result__snippet" in found.get("class", "").split():
                part = 2
        elif kind == "close" and tag in ("a", "td", "span"):
            part = -1
    seen: dict[str, tuple[str, str, str]] = {}
    for title, url, snippet in out:
        if url:
            seen.setdefault(url, (" ".join(title.split()), url, " ".join(snippet.split())))
    return [*seen.values()][:most]


def duckduckgo(answers: DataFrame, most: int = 10) -> DataFrame:
    """Results scraped from a results page in HTML."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (query_id, n + 1, *found)
                for query_id, body in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                for n, found in enumerate(_scraped(body or "", most))
            ]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["query_id", "position", "title", "url", "snippet"])

    rows = answers.select(F.col("query_id").cast("long"), "body").mapInArrow(parsed, "query_id long, position int, title string, url string, snippet string")
    return rows.withColumn("source", F.lit("duckduckgo"))


def chosen_backend(keys: dict[str, Column], asked: Column) -> Column:
    """The service that a search goes to: the one asked for, else the first whose key is set, else the scraper."""
    auto = F.coalesce(*[F.when(F.coalesce(keys[k], F.lit("")) != "", k) for k in ("serpapi", "exa", "brave") if k in keys], F.lit("duckduckgo"))
    return F.when(F.coalesce(asked, F.lit("auto")) == "auto", auto).otherwise(asked)
