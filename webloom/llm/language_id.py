"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased and everything but letters becomes one space; its subwords are
the letter pairs and triples of the padded words. Each is hashed to a row of an
embedding table; the mean of the rows goes through a linear layer and a softmax. The
model is trained by stochastic gradient descent in numpy on a bounded sample, a part
of which is held back to fit a temperature and the limits below which a text is
rejected: of its score, and of how usual its subwords are in any learned language, as a
text in an unlearned language can score high in a learned one. The model goes to the
executors as two tables (buckets x languages), whose size is fixed, and every whole
text is scored there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the sample at most, and the characters of each that are used, from a seeded place on.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 400
#: Rows that are drawn by their hash, as a multiple of SAMPLE_ROWS; the first of them in the hashes' order are taken.
DRAWN = 2
BUCKETS, DIM, EPOCHS, BATCH, RATE, SEED = 1 << 15, 16, 8, 32, 0.5, 42
#: Share of the held-back texts, each cut to these characters, that may score below the rejection threshold.
REJECTED, CUTS = 0.001, (16, 64, 160, SAMPLE_CHARS)
#: Deviations that a text may be less usual than the held-back texts are, and that one of a low score may be; a
#: text of several learned languages scores low, but is usual.
DEVIATIONS, LOW_DEVIATIONS = 10, 5
UNKNOWN = "und"
#: Code points that are looked at in one go.
SLICE = 1 << 18

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter; made once in a worker."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords, and the number of the text that each is from, in order."""
    lowered = [t.lower() for t in texts]
    joined = " ".join(["", *lowered, ""])  # a space first, and one after each text that counts as the text's
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    row = np.concatenate([np.zeros(len(points) - len(row), np.int64), row])
    letter = _letters()[points]
    kept = letter | np.append(True, letter[:-1])
    points, letter, row = np.where(letter, points, 32)[kept].astype(np.uint32), letter[kept], row[kept]
    if len(points) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair = points[:-1] * np.uint32(0x9E3779B1) ^ (points[1:] * np.uint32(0x85EBCA6B))
    triple = pair[:-1] ^ (points[2:] * np.uint32(0xC2B2AE35) + np.uint32(0x27D4EB2F))
    inner = letter[1:-1]
    hashed = np.concatenate([pair, triple[inner]])
    hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    rows = np.concatenate([row[1:], row[1:-1][inner]])
    return (hashed >> np.uint32(32 - 15)).astype(np.int64), rows


@dataclass(frozen=True)
class Model:
    """languages in order; logits of each bucket and language; bias; temperature; rejection threshold.

    ``usual`` are log frequencies of the buckets, each in the language that has it most;
    ``spread`` is their median mean in the held-back texts, the variance of that between
    texts, and the variance of single subwords.
    """

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    usual: np.ndarray
    spread: tuple[float, float, float]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities of each text's languages; zeros where a text has no letter."""
        return self.judged(texts)[0]

    def judged(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """scores, and whether each text is rejected."""
        shape = len(texts), len(self.languages)
        total, usual, count = np.zeros(shape), np.zeros(len(texts)), np.zeros(len(texts))
        for rows, parts in _slices(texts):
            bucket, row = subwords(parts)
            row = np.asarray(rows, np.int64)[row]
            count += np.bincount(row, minlength=len(texts))
            for i in range(len(self.languages)):
                total[:, i] += np.bincount(row, self.logits[i][bucket], len(texts))
            usual += np.bincount(row, self.usual[bucket], len(texts))
        logits = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        scores = odds / odds.sum(axis=1, keepdims=True) * (count > 0)[:, None]
        mean, between, single = self.spread
        n = np.maximum(count, 1)
        below = (mean - usual / n) / np.sqrt(between + single / n + 1e-12)
        low = (scores.max(axis=1) < self.threshold) & (below > LOW_DEVIATIONS)
        return scores, (count == 0) | low | (below > DEVIATIONS)


def _slices(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in batches of about SLICE characters; a longer text goes in parts that share two characters."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        text = text or ""
        for at in range(0, max(len(text), 1), SLICE):
            rows.append(row)
            parts.append(text[max(at - 2, 0) : at + SLICE])
            size += len(parts[-1])
            if size >= SLICE:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def train(texts: list[str], languages: list[str], seed: int = SEED) -> Model:
    """A model of the labelled texts; a fifth of them is held back for calibration."""
    rng = np.random.default_rng(seed)
    names = sorted(set(languages))
    label = np.array([names.index(x) for x in languages], np.int64)
    order = rng.permutation(len(texts))
    back = order[: len(texts) // 5]
    rest = order[len(texts) // 5 :]
    share = 1 / np.maximum(np.bincount(label[rest], minlength=len(names)), 1)
    weight = share[label] / share[label[rest]].mean() if len(rest) else share[label]
    table = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    layer, bias = rng.normal(0, 1, (DIM, len(names))), np.zeros(len(names))
    batches = []
    for at in range(0, len(rest), BATCH):
        rows = rest[at : at + BATCH]
        bucket, row = subwords([texts[i] for i in rows])
        cell, times = np.unique(row * BUCKETS + bucket, return_counts=True)
        row, bucket = cell // BUCKETS, cell % BUCKETS
        mean = times / np.maximum(np.bincount(row, times, len(rows)), 1)[row]
        batches.append((rows, row, bucket, mean))
    steps = EPOCHS * len(batches)
    for step in range(steps):
        rows, row, bucket, mean = batches[int(rng.integers(len(batches)))]
        rate = RATE * (1 - step / steps)
        used, place = np.unique(bucket, return_inverse=True)
        dense = np.zeros((len(rows), len(used)))
        dense[row, place] = mean
        hidden = dense @ table[used]
        odds = np.exp((z := hidden @ layer + bias) - z.max(axis=1, keepdims=True))
        slope = odds / odds.sum(axis=1, keepdims=True)
        slope[np.arange(len(rows)), label[rows]] -= 1
        slope *= weight[rows][:, None] / len(rows)
        # A mean over hundreds of subwords moves each little, so the table's rate is scaled up.
        table[used] -= rate * 100 * (dense.T @ (slope @ layer.T))
        layer -= rate * (hidden.T @ slope)
        bias -= rate * slope.sum(axis=0)
    logits = np.ascontiguousarray((table @ layer).T.astype(np.float32))
    seen = np.zeros((len(names), BUCKETS))
    for rows, row, bucket, mean in batches:
        np.add.at(seen, (label[rows][row], bucket), mean)
    seen += 0.5 * max(len(rest), 1) / (100 * BUCKETS * len(names))
    usual = np.log(seen / seen.sum(axis=1, keepdims=True)).astype(np.float32)
    model = Model(names, logits, bias, 1.0, 0.0, usual.max(axis=0), (0.0, np.inf, 0.0))
    return _calibrated(model, [texts[i] for i in back], label[back])


def _calibrated(model: Model, texts: list[str], label: np.ndarray) -> Model:
    """model with the temperature of least log loss on texts, and limits of rejection from their scores and subwords.

    The score's limit is the REJECTED quantile over the texts at several lengths. With
    less than two texts there is no limit of usual subwords.
    """
    if not len(texts):
        return model
    best = None
    for temperature in np.geomspace(0.05, 4, 40):
        tried = replace(model, temperature=float(temperature))
        scores = tried.scores(texts)
        loss = -np.log(np.maximum(scores[np.arange(len(texts)), label], 1e-12)).mean()
        if best is None or loss < best[0]:
            best = (loss, tried)
    cut = [t[:n] for n in CUTS for t in texts]
    top = best[1].scores(cut).max(axis=1)
    threshold = float(np.quantile(top[top > 0], REJECTED, method="lower")) if top.any() else 0.0
    bucket, row = subwords(texts)
    count = np.bincount(row, minlength=len(texts))
    own, values = count > 0, model.usual[bucket].astype(float)
    if own.sum() < 2:
        return replace(best[1], threshold=threshold)
    means = np.bincount(row, values, len(texts))[own] / count[own]
    # Medians, as some texts hold parts in other languages.
    middle = np.median(means)
    between = (1.4826 * np.median(np.abs(means - middle))) ** 2
    return replace(best[1], threshold=threshold, spread=(float(middle), float(between), float(values.var())))


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 by 4. A null id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[str]]:
    """At most ``rows`` texts (of each ``chars`` characters from a seeded place on) with their languages.

    The labelled rows are counted first, without their texts. Only rows whose hash is low
    enough for about DRAWN times the wanted rows are sorted, so what the tasks send to the
    driver doesn't grow with the table. ``chars`` bounds what is learned from one text, as
    a mean of a few hundred subwords is what the model sees of most texts.
    """
    labelled = docs.filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()
    )
    order = F.xxhash64(F.lit(SEED), "doc_id")
    share = min(1.0, DRAWN * rows / max(labelled.count(), 1))
    low = F.shiftrightunsigned(order, 33) < F.lit(int(share * (1 << 31)))
    from_ = F.pmod(order, F.greatest(F.char_length("text") - chars, F.lit(1))).cast("int") + 1
    drawn = (
        labelled.filter(low)
        .select(order.alias("order"), "doc_id", "lang", F.substring("text", from_, F.lit(chars)).alias("text"))
        .orderBy("order", "doc_id", "lang", "text")
        .limit(rows)
        .toPandas()
    )
    return drawn["text"].tolist(), drawn["lang"].tolist()


#: The columns that a prediction adds.
TOLD = ("lang_pred", "score", "rejected")


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None, named: tuple[str, str, str] = TOLD) -> DataFrame:
    """The columns of docs (or those to keep) with lang_pred, score, rejected for every whole text.

    lang_pred is UNKNOWN, with score 0 and rejected, if the text is null or has no letter, or
    if there is no model; else a learned language, rejected if its subwords are too unusual in
    all learned languages, and sooner if its score is below the model's threshold. ``named`` are the names of the three columns;
    columns of docs that have one of them are replaced.
    """
    kept = [c for c in keep or docs.columns if c not in named]
    schema = docs.select(*kept).schema.add(named[0], "string").add(named[1], "double").add(named[2], "boolean")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            texts = batch.column("text").to_pylist()
            scores, rejected = model.judged(texts) if model else (np.zeros((n, 1)), np.ones(n, bool))
            best, top = scores.argmax(axis=1), scores.max(axis=1)
            names = [model.languages[b] if s > 0 else UNKNOWN for b, s in zip(best, top, strict=True)]
            columns = [*batch.select(kept).columns, pa.array(names, pa.string()), pa.array(top), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *named])

    read = [*kept, *(["text"] if "text" not in kept else [])]
    return docs.select(*read).mapInArrow(score, schema)


def identify(docs: DataFrame, keep: list[str] | None = None, named: tuple[str, str, str] = TOLD) -> DataFrame:
    """predict(docs) by a model of the labelled rows of docs.

    Only text and language of rows that aren't held out are learned from; a null doc_id
    is neither held out nor learned from. Without a labelled row every text is UNKNOWN.
    Repeated rows are scored as often as they stand; an empty table gives no rows.
    """
    texts, languages = training_sample(docs)
    return predict(docs, train(texts, languages) if texts else None, keep, named)
