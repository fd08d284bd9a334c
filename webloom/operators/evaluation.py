"""Labelled regions, training and evaluation of content models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import fixed
from webloom.operators.regions import label_nodes
from webloom.runtime import checkpointed, portions

__all__ = ["ContentModel", "ablation", "confusion", "gradient_models", "label_nodes", "leave_one_out", "top_hits"]


def confusion(rows: DataFrame, truth: Column, guess: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy, for each group of ``by``."""
    hits = {"tp": truth & guess, "fp": ~truth & guess, "fn": truth & ~guess, "tn": ~truth & ~guess}
    counted = rows.groupBy(*(by or [])).agg(*[F.count_if(c).alias(k) for k, c in hits.items()])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counted.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)})


@dataclass
class ContentModel:
    """A logistic regression over standardised features."""

    names: list[str]
    weights: np.ndarray
    bias: float
    means: np.ndarray
    scales: np.ndarray

    def probability(self) -> Column:
        """The model's probability over the feature columns."""
        z = F.lit(self.bias)
        for name, w, m, s in zip(self.names, self.weights, self.means, self.scales, strict=True):
            if w:
                z = z + (F.col(name) - float(m)) / float(s) * float(w)
        return 1 / (1 + F.exp(-z))


def _blocks(labelled: DataFrame, names: list[str], fold: str | None, rows: int = 8192) -> DataFrame:
    """Runs of rows as one row each: their features column by column, labels and folds.

    They are read in every step, so features are compressed: flags and values that repeat in a column take little then.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                x = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in names]).astype(np.float64)
                y, own = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("label", "fold"))
                held = (pa.compress(x.tobytes(), "lz4", asbytes=True), y.tobytes(), own.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in held], ["x", "y", "fold"])

    own = F.col(fold).cast("long") if fold else F.lit(0).cast("long")
    return checkpointed(labelled.select(*names, F.col("label").cast("long"), own.alias("fold")).mapInArrow(pack, "x binary, y binary, fold binary"))


def gradient_models(
    labelled: DataFrame, leave: list[tuple[int | None, tuple[str, ...]]], fold: str | None = None, iterations: int = 600, rate: float = 0.35, l2: float = 0.01
) -> list[ContentModel]:
    """A model for each (fold, names) of leave, trained without the rows of that fold and without those features. labelled: f_* and label 0 or 1.

    Features are standardised by the rows of each training, classes weigh alike, and ``iterations`` full gradients are followed from zero. All models
    take their steps together: a step is one pass of a task a core over packed rows, and the driver sees a number a model, feature and core. Models that
    leave out the same fold share its rows. Without a row of a class the other weighs one; a feature that doesn't vary has scale 1. Folds are whole
    numbers. No rows are an error.
    """
    names = [f"f_{k}" for k in fixed.CONTENT_MODEL]
    packed = _blocks(labelled, names, fold).coalesce(labelled.sparkSession.sparkContext.defaultParallelism)
    d, folds = len(names), [f for f, _ in leave]
    kept = np.array([[0.0 if n.removeprefix("f_") in without else 1.0 for n in names] for _, without in leave])

    def summed(part, size: int) -> np.ndarray:
        """The sum over all blocks of part(x, y, own), an array of one number for each model and place."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(folds), size))
            for batch in portions(batches, 1):
                x, y, own = (batch.column(c)[0].as_buffer() for c in ("x", "y", "fold"))
                x = pa.decompress(x, d * y.size, "lz4")
                total += part(np.frombuffer(x).reshape(d, -1).T, np.frombuffer(y, np.int64), np.frombuffer(own, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        parts = packed.mapInArrow(each, "total binary").toArrow().column("total").to_pylist()
        return sum((np.frombuffer(p).reshape(len(folds), size) for p in parts), np.zeros((len(folds), size)))

    inside = lambda own: np.stack([np.ones(len(own)) if f is None else (own != f) * 1.0 for f in folds])
    first = summed(lambda x, y, own: np.concatenate([(m := inside(own)).sum(axis=1)[:, None], (m @ y)[:, None], m @ x], axis=1), d + 2)
    n, positive = first[:, 0], first[:, 1]
    if not n.all():
        raise ValueError("a training without rows")
    means = first[:, 2:] / n[:, None]
    squares = summed(lambda x, y, own: np.stack([m @ (x - mean) ** 2 for m, mean in zip(inside(own), means, strict=True)]), d)
    scales = np.sqrt(squares / n[:, None])
    scales[scales == 0] = 1.0
    share = np.stack([n / (2 * np.maximum(n - positive, 1)), n / (2 * np.maximum(positive, 1))], axis=1)
    share[(positive == 0) | (positive == n)] = 1.0
    weights, bias = np.zeros((len(folds), d)), np.zeros(len(folds))
    alike = {f: [k for k, other in enumerate(folds) if other == f] for f in folds}
    for _ in range(iterations):

        def gradient(x, y, own, weights=weights, bias=bias):
            out = np.zeros((len(folds), d + 1))
            for f, ks in alike.items():
                rows = slice(None) if f is None else own != f
                z, truth = (x[rows] - means[ks[0]]) / scales[ks[0]], y[rows]
                error = (1 / (1 + np.exp(-np.clip(bias[ks] + z @ weights[ks].T, -700, 700))) - truth[:, None]) * share[ks[0]][truth][:, None]
                out[ks] = np.column_stack([error.T @ z, error.sum(axis=0)])
            return out

        g = summed(gradient, d + 1) / n[:, None]
        weights = weights - rate * (g[:, :d] + l2 * weights) * kept
        bias = bias - rate * g[:, d]
    return [ContentModel(names, weights[k], float(bias[k]), means[k], scales[k]) for k in range(len(folds))]


def leave_one_out(labelled: DataFrame, fold: str, folds: list[int], without: tuple[str, ...] = (), iterations: int = 600) -> DataFrame:
    """page_id, nid, fold, label, guess, score: every row scored by a model of the other folds.

    ``folds`` are whole numbers, one can be a page; their models are trained together.
    """
    models = gradient_models(labelled, [(f, without) for f in folds], fold, iterations)
    return _scored(labelled, fold, folds, models)


def _scored(labelled: DataFrame, fold: str, folds: list[int], models: list[ContentModel]) -> DataFrame:
    score = F.lit(None).cast("double")
    for one, model in zip(folds, models, strict=True):
        score = F.when(F.col(fold) == one, model.probability()).otherwise(score)
    found = labelled.filter(F.col(fold).isin(folds)).withColumn("score", score)
    return found.select(*dict.fromkeys(["page_id", "nid", fold]), "label", (F.col("score") >= 0.5).cast("int").alias("guess"), "score")


def top_hits(scored: DataFrame) -> DataFrame:
    """pages, hits, top_hit_rate: pages whose row of the highest score, the first of equals, has label 1."""
    best = scored.groupBy("page_id").agg(F.max_by("label", F.struct("score", -F.col("nid"))).alias("label"))
    hits = F.count_if(F.col("label") == 1)
    return best.agg(F.count("*").alias("pages"), hits.alias("hits"), F.when(F.count("*") > 0, hits / F.count("*")).otherwise(0.0).alias("top_hit_rate"))


def ablation(labelled: DataFrame, fold: str, folds: list[int], iterations: int = 600) -> DataFrame:
    """dropped, f1, top_hit_rate, delta_f1 for all features (dropped: null) and without each group of them.

    The models of all groups and folds are trained together, in as many passes as one model takes.
    """
    groups = [None, *fixed.FEATURE_GROUPS]
    left = {g: tuple(fixed.FEATURE_GROUPS[g].split()) if g else () for g in groups}
    models = gradient_models(labelled, [(f, left[g]) for g in groups for f in folds], fold, iterations)
    rows = None
    for i, group in enumerate(groups):
        scored = _scored(labelled, fold, folds, models[i * len(folds) : (i + 1) * len(folds)]).withColumn("dropped", F.lit(group or ""))
        rows = scored if rows is None else rows.unionByName(scored)
    best = rows.groupBy("dropped", "page_id").agg(F.max_by("label", F.struct("score", -F.col("nid"))).alias("label"))
    hits = best.groupBy("dropped").agg((F.count_if(F.col("label") == 1) / F.count("*")).alias("top_hit_rate"))
    told = confusion(rows, F.col("label") == 1, F.col("guess") == 1, ["dropped"]).join(hits, "dropped")
    whole = F.max(F.when(F.col("dropped") == "", F.col("f1"))).over(Window.partitionBy(F.lit(0)))  # a row a group
    return told.select(F.nullif("dropped", F.lit("")).alias("dropped"), "f1", "top_hit_rate", (F.col("f1") - whole).alias("delta_f1"))
