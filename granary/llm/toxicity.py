"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is the sum of hashed embeddings of itself and of its first letters; filters of several
widths run over the whole text, each keeps its maximum, a logistic unit weighs the maxima. The
model is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``, chosen by hash), a part of
which sets the scale of the scores and a threshold for each language. Scoring covers all rows and
whole texts: per word the filters' partial products are cached, so a text costs one gather.

Defined cases: null and empty texts are scored (the filters then see padding only); a null
doc_id counts as held out from learning; a document with several labels is toxic if one of them
says so; of several texts of one doc_id one is learned from; an unknown or null language takes the
common threshold; without labelled rows of both classes every score is the share of toxic labels (0 if none).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import WordCache, as_bytes

#: Labelled rows that the model is fitted on, at most, and bytes of their texts.
SAMPLE_ROWS, SAMPLE_BYTES = 6_000, 200_000_000
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 12, 8, (1, 2, 3)
#: A word's embeddings: the word itself and prefixes of so many characters.
PREFIXES = (3, 4, 5)
SPAN = sum(WIDTHS) * FILTERS


def word_buckets(word: bytes) -> tuple[int, ...]:
    """Buckets of a lower-cased word: of itself and of its prefixes."""
    text = word.decode("utf-8", "replace").lower().strip(".,;:!?\"'()[]")
    parts = [f"={text}", *(f"{k}{text[:k]}" for k in PREFIXES)]
    return tuple(zlib.crc32(p.encode()) % BUCKETS for p in parts)


@dataclass
class Model:
    embed: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, DIM, FILTERS)
    bias: dict[int, np.ndarray]
    weights: np.ndarray
    intercept: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None

    @staticmethod
    def fresh(seed: int) -> Model:
        r = np.random.default_rng(seed)
        return Model(
            r.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32),
            {w: r.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS},
            {w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
            r.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
            -1.0,
        )

    def spread(self, buckets: np.ndarray) -> np.ndarray:
        """Each word's partial products with every filter's every place, (words, SPAN)."""
        x = self.embed[buckets].sum(1)
        return np.concatenate([x @ self.filters[w][j] for w in WIDTHS for j in range(w)], axis=1)

    def logit(self, rows: np.ndarray) -> float:
        """Of a text, from its words' partial products."""
        at, top = 0, []
        for w in WIDTHS:
            if len(rows) < w:
                rows = np.concatenate([rows, np.zeros((w - len(rows), rows.shape[1]), rows.dtype)])
            n = len(rows) - w + 1
            total = rows[:n, at : at + FILTERS]
            for j in range(1, w):
                total = total + rows[j : j + n, at + j * FILTERS : at + (j + 1) * FILTERS]
            top.append(np.maximum(total.max(0) + self.bias[w], 0))
            at += w * FILTERS
        return float(np.concatenate(top) @ self.weights + self.intercept)

    def score(self, logit: float) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -50, 50))))


def _learn(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7, epochs: int = 6, rate: float = 0.02) -> Model:
    """Adagrad over single texts; gradients pass through each filter's maximum only."""
    model = Model.fresh(seed)
    state = {"embed": np.full((BUCKETS, DIM), 1e-2, np.float32), "weights": np.full_like(model.weights, 1e-2), "intercept": 1e-2}
    held = {w: (np.full_like(model.filters[w], 1e-2), np.full_like(model.bias[w], 1e-2)) for w in WIDTHS}
    heavier = float(np.clip((len(labels) - labels.sum()) / max(1, labels.sum()), 1, 10)) ** 0.5
    r = np.random.default_rng(seed)
    easy = np.zeros(len(texts), bool)  # settled ones are visited now and then only
    for _ in range(epochs):
        for i in r.permutation(len(texts)):
            if easy[i] and r.random() > 0.2:
                continue
            b = texts[i]
            x = model.embed[b[:, 0]]
            for k in range(1, b.shape[1]):
                x += model.embed[b[:, k]]
            tops, places = [], []
            for w in WIDTHS:
                xx = np.concatenate([x, np.zeros((w - len(x), DIM), np.float32)]) if len(x) < w else x
                n = len(xx) - w + 1
                conv = sum(xx[j : j + n] @ model.filters[w][j] for j in range(w)) + model.bias[w]
                place = conv.argmax(0)
                tops.append(conv[place, np.arange(FILTERS)])
                places.append((place, xx))
            hidden = np.concatenate(tops)
            active = np.maximum(hidden, 0)
            error = 1 / (1 + np.exp(-np.clip(float(active @ model.weights + model.intercept), -50, 50))) - labels[i]
            easy[i] = abs(error) < 0.02
            error *= heavier if labels[i] else 1.0
            if abs(error) < 1e-3:
                continue
            back = error * model.weights * (hidden > 0)
            grad = error * active
            state["weights"] += grad**2
            model.weights -= rate * grad / np.sqrt(state["weights"])
            state["intercept"] += error**2
            model.intercept -= rate * error / state["intercept"] ** 0.5
            words, steps = [], []
            for k, w in enumerate(WIDTHS):
                d = back[k * FILTERS : (k + 1) * FILTERS].astype(np.float32)
                if not d.any():
                    continue
                place, xx = places[k]
                for j in range(w):
                    seen = xx[place + j]  # (FILTERS, DIM)
                    g = (seen * d[:, None]).T
                    into = d[:, None] * model.filters[w][j].T
                    held[w][0][j] += g**2
                    model.filters[w][j] -= rate * g / np.sqrt(held[w][0][j])
                    inside = (place + j < len(b)) & (d != 0)
                    words.append(b[place[inside] + j])
                    steps.append(into[inside])
                held[w][1][:] += d**2
                model.bias[w] -= rate * d / np.sqrt(held[w][1])
            if words:
                rows = np.concatenate(words)
                step = np.repeat(np.concatenate(steps), rows.shape[1], axis=0)
                rows, inverse = np.unique(rows, return_inverse=True)
                total = np.zeros((len(rows), DIM), np.float32)
                np.add.at(total, inverse.ravel(), step)
                state["embed"][rows] += total**2
                model.embed[rows] -= rate * total / np.sqrt(state["embed"][rows])
    return model


def _threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The score with the best F1, midway to the next lower one."""
    order = np.argsort(-scores, kind="stable")
    hit = np.cumsum(labels[order])
    f1 = 2 * hit / (np.arange(1, len(order) + 1) + max(1, labels.sum()))
    best = int(f1.argmax())
    below = scores[order[best + 1]] if best + 1 < len(order) else 0.0
    return float((scores[order[best]] + below) / 2)


def held_out():
    """Rows that nothing is learned from: crc32 of doc_id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sampled(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, toxic, lang, body: one row of each of at most ``rows`` labelled documents outside the held-out part.

    Documents are taken in the order of a hash until their texts reach ``size`` bytes.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.withColumn("_order", F.xxhash64("doc_id")).orderBy("_order", "doc_id").limit(rows)
    texts = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), as_bytes("text").alias("body")).join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id", "toxic", "_order").agg(F.min_by(F.struct("lang", "body"), F.struct(F.xxhash64("body"), "lang")).alias("t"))
    upto = Window.orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # of ``rows`` rows at most
    lengths = one.select("doc_id", "_order", F.octet_length("t.body").alias("n")).withColumn("n", F.sum("n").over(upto)).where(F.col("n") <= size).select("doc_id")
    return one.join(F.broadcast(lengths), "doc_id").select("doc_id", "toxic", "t.lang", "t.body")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 7) -> Model:
    """Fit on a bounded sample of labelled rows, see ``sampled``."""
    sample = sampled(docs, labels, rows)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(word_buckets)
        for b in batches:
            ids = [[x for w in t.split() for x in cache[w]] for t in b["body"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), b["toxic"].cast(pa.int32()), b["lang"].cast(pa.string()), pa.array(ids, pa.list_(pa.int16()))], ["doc_id", "toxic", "lang", "ids"])

    # buckets are below 2**15: two bytes each, which bounds what the driver holds
    got = sample.mapInArrow(encode, "doc_id long, toxic int, lang string, ids array<smallint>").toArrow()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    labels_ = (got["toxic"].to_numpy()[order] == 1).astype(np.int64)
    langs = np.array([x or "" for x in got["lang"].to_pylist()], object)[order]
    lists = got["ids"].combine_chunks()
    texts = [lists[int(i)].values.to_numpy().reshape(-1, 1 + len(PREFIXES)) for i in order]
    if len(set(labels_.tolist())) < 2:
        return Model(*_blank(), constant=float(labels_.mean()) if len(labels_) else 0.0)
    tune = np.arange(len(texts)) % 5 == 0
    model = _learn([t for t, x in zip(texts, tune) if not x], labels_[~tune], seed)
    where = tune if len(set(labels_[tune].tolist())) == 2 else np.ones(len(texts), bool)
    logits = np.array([model.logit(model.spread(t)) for t, x in zip(texts, where) if x])
    y = labels_[where]
    # scale and shift: the score with the best F1 becomes 0.5
    middle = _threshold(logits - logits.min(), y) + logits.min()
    gap = max(1e-3, float(logits[y == 1].mean() - logits[y == 0].mean()))
    model.scale, model.shift = 6.0 / gap, -6.0 / gap * middle
    scores = np.array([model.score(x) for x in logits])
    model.thresholds = {"": 0.5}
    for lang in sorted(set(langs[where].tolist())):
        own = langs[where] == lang
        if y[own].sum() >= 10 and (1 - y[own]).sum() >= 10:
            model.thresholds[lang] = float(np.clip(_threshold(scores[own], y[own]), 0.2, 0.8))
    return model


def _blank():
    m = Model.fresh(0)
    return m.embed, m.filters, m.bias, m.weights, m.intercept


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score and toxic (score >= its language's threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: about 2 MB

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        limit = 100_000
        rows = np.zeros((limit, SPAN), np.float32)
        places: dict[bytes, int] = {}
        for bodies in batches:
            scores = []
            for text in bodies:
                words = text.split()
                if len(places) + len(words) > limit:
                    places.clear()
                new = [w for w in dict.fromkeys(words) if w not in places]
                if len(new) > limit:  # more distinct words than the cache holds
                    scores.append(model.score(model.logit(model.spread(np.array([word_buckets(w) for w in words])))))
                    continue
                if new:
                    start = len(places)
                    places.update(zip(new, range(start, start + len(new))))
                    rows[start : start + len(new)] = model.spread(np.array([word_buckets(w) for w in new]))
                at = np.fromiter(map(places.__getitem__, words), np.int32, len(words))
                scores.append(model.score(model.logit(rows[at])))
            yield pd.Series(scores, dtype="float64")

    limit = F.lit(model.thresholds.get("", 0.5))
    for lang, value in model.thresholds.items():
        if lang:
            limit = F.when(F.col("lang") == lang, F.lit(value)).otherwise(limit)
    return docs.withColumn("score", score(as_bytes("text"))).withColumn("toxic", F.col("score") >= limit)
