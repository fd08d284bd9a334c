"""Gradient training against a plain loop, and the labelled pages of several layouts, each left out in turn."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.functions import fixed
from webloom.operators import evaluation, readability, regions
from webloom.sources import dom

NAMES = [f"f_{k}" for k in fixed.CONTENT_MODEL]


def plain(x, y, iterations, rate=0.35, l2=0.01, kept=1.0):
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    z, w, b = (x - mean) / scale, np.zeros(x.shape[1]), 0.0
    share = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1))) if 0 < y.sum() < len(y) else np.ones(len(y))
    for _ in range(iterations):
        error = (1 / (1 + np.exp(-(b + z @ w))) - y) * share
        w = w - rate * (error @ z / len(y) + l2 * w) * kept
        b -= rate * error.mean()
    return w, b


def test_models_agree_with_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, len(NAMES))) * rng.uniform(0.1, 3, len(NAMES))
    x[:, 3] = 1.5
    y = (x[:, 0] + rng.normal(size=200) > 0.5).astype(int)
    fold = rng.integers(0, 3, 200)
    rows = [(*map(float, r), int(t), int(f)) for r, t, f in zip(x, y, fold, strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in NAMES) + ", label int, fold int").repartition(3)
    out = tuple(list(fixed.CONTENT_MODEL)[:4])
    models = evaluation.gradient_models(df, [(None, ()), (1, ()), (None, out)], "fold", 12)
    kept = np.array([0.0] * 4 + [1.0] * (len(NAMES) - 4))
    for model, (w, b) in zip(models, [plain(x, y, 12), plain(x[fold != 1], y[fold != 1], 12), plain(x, y, 12, kept=kept)], strict=True):
        assert np.allclose(model.weights, w, atol=1e-9) and model.bias == pytest.approx(b, abs=1e-9)
    z = (x - models[0].means) / models[0].scales
    found = [r.p for r in spark.createDataFrame(rows, df.schema).select(models[0].probability().alias("p")).collect()]
    assert np.allclose(found, 1 / (1 + np.exp(-(z @ models[0].weights + models[0].bias))))
    with pytest.raises(ValueError):
        evaluation.gradient_models(df.filter("fold = 1"), [(1, ())], "fold", 1)


WORDS = "The quick brown fox jumps over the lazy dog, and then it rests in the shade of an old tree for a while."
MENU = "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(12))
LAYOUTS = [
    f"<body><nav id=n><ul>{MENU}</ul></nav><article><h1>T</h1><p>{WORDS * 3}</p><p>{WORDS * 2}</p></article><footer id=f><p><a href=/x>About</a></p></footer></body>",
    f"<body><div class='sidebar'><ul>{MENU}</ul></div><div id='content'><h2>T</h2><p>{WORDS * 4}</p><div><p>{WORDS}</p></div></div></body>",
    f"<body><header><div class='menu'>{MENU}</div></header><main><section><p>{WORDS * 2}</p><p>{WORDS * 2}</p><p>{WORDS * 3}</p></section></main><aside><ul>{MENU}</ul></aside></body>",
    f"<body><div><div class='post'><p>{WORDS * 5}</p><blockquote>{WORDS * 2}</blockquote></div><div class='comments'><form><p>Name</p></form></div></div><footer><ul>{MENU}</ul></footer></body>",
    f"<body><table><tr><td><ul>{MENU}</ul></td><td id='content'><p>{WORDS * 3}</p><p>{WORDS * 3}</p></td></tr></table></body>",
]
GOOD = ["//article", "//*[@id='content']", "//main", "//div[@class='post']"]
BAD = ["//nav", "//footer", "//aside", "//header", "//*[contains(@class, 'sidebar')]", "//*[@class='comments']", "//td[1]"]


def test_pages_left_out_are_told(spark):
    pages = spark.createDataFrame([(i, f"https://e{i}.com/", h) for i, h in enumerate(LAYOUTS)], "page_id long, url string, html string")
    found = dom.nodes(pages).cache()
    labels = regions.labelled_by_paths(found, GOOD, BAD).select("page_id", "nid", "label")
    rows = readability.content_features(found).join(labels, ["page_id", "nid"]).cache()
    scored = evaluation.leave_one_out(rows, "page_id", list(range(len(LAYOUTS))), iterations=60)
    told = evaluation.confusion(scored, F.col("label") == 1, F.col("guess") == 1).first()
    assert told.f1 >= 0.45 and told.tp + told.fp + told.fn + told.tn == rows.count()
    assert evaluation.top_hits(scored).first().top_hit_rate >= 0.6


def test_ablation_takes_all_steps(spark, monkeypatch):
    from webloom.plans import catalog

    taken = []

    def asked(labelled, leave, fold=None, iterations=600):
        taken.append((len(leave), iterations))
        raise KeyError

    monkeypatch.setattr(evaluation, "gradient_models", asked)
    with pytest.raises(KeyError):
        catalog.queries()["content_ablation"](spark, "/root/testdata/sf0.001")
    assert taken == [(2 * (1 + len(fixed.FEATURE_GROUPS)), 600)]


def test_models_that_share_a_fold_agree_with_a_plain_loop(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(9000, len(NAMES))) * rng.uniform(0.1, 3, len(NAMES))
    x[:, 3], x[:, 4] = 0.25, x[:, 4] > 0
    y, fold = (x[:, 0] + rng.normal(size=9000) > 0.5).astype(int), rng.integers(0, 2, 9000)
    rows = [(*map(float, r), int(t), int(f)) for r, t, f in zip(x, y, fold, strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in NAMES) + ", label int, fold int").repartition(7)
    out, kept = tuple(list(fixed.CONTENT_MODEL)[5:9]), np.array([1.0] * 5 + [0.0] * 4 + [1.0] * (len(NAMES) - 9))
    models = evaluation.gradient_models(df, [(1, ()), (0, out), (1, out), (0, ())], "fold", 8)
    for model, f, k in zip(models, (1, 0, 1, 0), (1.0, kept, kept, 1.0), strict=True):
        w, b = plain(x[fold != f], y[fold != f], 8, kept=k)
        assert np.allclose(model.weights, w, atol=1e-9) and model.bias == pytest.approx(b, abs=1e-9)
