"""Ranked search inside documents: BM25 over paragraphs or sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def passages(docs: DataFrame, by: str = "paragraph") -> DataFrame:
    """doc_id, pos, text: the paragraphs (lines) or sentences of documents (doc_id, text)."""
    pattern = r"\n+" if by == "paragraph" else r"(?<=[.!?])\s+"
    parts = docs.select("doc_id", F.posexplode(F.split("text", pattern)).alias("pos", "text"))
    return parts.filter(F.trim("text") != "")


def _is(term: str):
    return lambda word: word == term


def _terms(query: str) -> list[str]:
    return sorted(set(query.lower().split()))


def _counted(parts: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, pos, text, n words, and tf0, tf1, ..., how often each term stands in a passage."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    counts = [F.size(F.filter("words", _is(t))) for t in terms]
    return parts.withColumn("words", words).select("doc_id", "pos", "text", F.size("words").alias("n"), *[c.alias(f"tf{i}") for i, c in enumerate(counts)])


def bm25(parts: DataFrame, query: str, top_k: int = 10) -> DataFrame:
    """doc_id, pos, text, score, rank: the passages of each document that fit the query best.

    Statistics are those of the passage's own document. Query terms are known on the
    driver, so each passage is matched once and only its counts are shuffled; a term
    that every passage holds still adds a little.
    """
    terms = _terms(query)
    rows = _counted(parts, terms)
    whole = rows.groupBy("doc_id").agg(
        F.count("*").alias("passages"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]
    )
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("passages") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    return _best(rows.join(whole, "doc_id").withColumn("score", score), top_k)


def term_frequency(parts: DataFrame, query: str, top_k: int = 10) -> DataFrame:
    """doc_id, pos, text, score, rank: the passages of each document that hold the query's terms most often."""
    terms = _terms(query)
    score = F.lit(0)
    for i in range(len(terms)):
        score = score + F.col(f"tf{i}")
    return _best(_counted(parts, terms).withColumn("score", score.cast("double")), top_k)


def _best(scored: DataFrame, top_k: int) -> DataFrame:
    """The passages of each document with the highest scores above zero."""
    scored = scored.filter("score > 0")
    ranked = Window.partitionBy("doc_id").orderBy(F.desc(F.round("score", 9)), "pos")
    out = scored.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top_k)
    return out.select("doc_id", "pos", "text", "score", "rank")
