"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the mean of hashed rows: one for the word, one for each
of its prefixes of three, four and six bytes and one for its ending, so that
unseen inflections share rows with seen ones.  Filters of widths one to three
slide over the words, each is max-pooled over the whole text, and a logistic
unit reads the maxima.  Training runs Adam on a bounded sample of labelled rows
(``TRAIN_ROWS``); a part of them picks the epoch, a Platt scale fitted on that
part makes the score a probability, and decision thresholds are calibrated by
language.  Only the text enters a score; language only selects the threshold
of the verdict column.

Rows of the held-out fold (crc32 of the id as text, mod 4, equal to 2) are
never learned from.

Defined results: a null text scores as an empty one; a null id is not held out
and keeps its row; a null or unknown language takes the global threshold;
repeated rows are scored alike; an empty table gives no rows; with fewer than
two classes among the training labels every text scores the base rate.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import fold_of, fold_of_value, map_rows

BUCKETS = 1 << 16
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
#: Rows of a word: itself, its first three, four and six bytes, its last four.
FEATURES = 5
#: Most labelled rows that the classifier is fitted on.
TRAIN_ROWS = 5_000
#: Optimiser steps in all, of BATCH rows each; small samples take more epochs.
STEPS, BATCH = 1_300, 32
#: Epochs without a better loss on the part set aside, after which training ends.
PATIENCE = 10
HELD_OUT_FOLD = 2
THRESHOLD = 0.3
CACHE_WORDS = 400_000
PUNCTUATION = ".,;:!?\"'()[]{}<>*#$%&|-_=+/\\"


def word_rows(word: str) -> tuple[int, ...]:
    """Embedding rows of a word; repeated rows stand for affixes that it lacks."""
    data = word.lower().strip(PUNCTUATION).encode("utf-8", "replace")
    whole, size = crc32(data, 1) % BUCKETS, len(data)
    if size < 3:
        return (whole,) * FEATURES
    three = crc32(data[:3])
    four = crc32(data[3:4], three)
    six = crc32(data[4:6], four) if size >= 6 else four
    return whole, three % BUCKETS, four % BUCKETS, six % BUCKETS, crc32(data[-4:], 2) % BUCKETS


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]  # by width: (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)

    def project(self, vectors: np.ndarray) -> np.ndarray:
        """Share of each word in every filter, by offset: offset k serves the filters wider than k."""
        return np.concatenate([vectors @ f[k] for k in range(max(WIDTHS)) for f in self.filters if len(f) > k], axis=1)

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.out + self.out_bias

    def probability(self, logit: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))


def responses(projected: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Filter responses (positions, filters) over a padded id sequence; widths are one more each."""
    n, at, total = len(ids) - max(WIDTHS) + 1, len(WIDTHS) * FILTERS, len(WIDTHS) * FILTERS
    shares = projected[ids]
    out = shares[:n, :total].copy()
    for k in range(1, max(WIDTHS)):
        rest = total - k * FILTERS
        out[:, k * FILTERS :] += shares[k : n + k, at : at + rest]
        at += rest
    return out


def train(texts: list[str], labels: list[int], langs: list[str | None], seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, dtype=np.float32)
    model = Model(
        rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32),
        [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32),
        rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
        float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))) if len(y) else -3.0,
    )
    if len(set(labels)) < 2:
        model.out[:] = 0
        return model
    vocab: dict[str, int] = {"": 0}
    pads = [0] * (max(WIDTHS) - 1)
    docs = [np.array([vocab.setdefault(w, len(vocab)) for w in t.split()] + pads + [0], dtype=np.int64) for t in texts]
    rows = np.array([word_rows(w) for w in vocab], dtype=np.int64)
    order = rng.permutation(len(docs))
    held = order[: max(1, len(docs) // 6)]
    fit = order[len(held) :]
    params = [model.table, *model.filters, model.bias, model.out]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    out_bias, moments, step, rate = np.array([model.out_bias]), np.zeros(2), 0, 0.004
    best, stale = (np.inf, None), 0
    for _ in range(math.ceil(STEPS * BATCH / len(fit))):
        rng.shuffle(fit)
        for start in range(0, len(fit), BATCH):
            batch = fit[start : start + BATCH]
            step += 1
            grads = _gradients(model, docs, rows, y, batch, rng)
            for p, g, m, v in zip(params, grads[:-1], first, second):
                if p is model.table:
                    at, g = g
                    m[at] = 0.9 * m[at] + 0.1 * g
                    v[at] = 0.999 * v[at] + 0.001 * g * g
                    p[at] -= rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.999**step)) + 1e-6)
                else:
                    m[:] = 0.9 * m + 0.1 * g
                    v[:] = 0.999 * v + 0.001 * g * g
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
            moments[:] = 0.9 * moments[0] + 0.1 * grads[-1], 0.999 * moments[1] + 0.001 * grads[-1] ** 2
            out_bias -= rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-6)
            model.out_bias = float(out_bias[0])
        z = _logits(model, docs, rows, held)
        loss = float(np.mean(np.logaddexp(0, z) - y[held] * z))
        stale += 1
        if loss < best[0]:
            best, stale = (loss, [p.copy() for p in params] + [model.out_bias]), 0
        if stale >= PATIENCE:
            break
    model.table, *rest = best[1]
    model.filters, (model.bias, model.out, model.out_bias) = rest[: len(WIDTHS)], rest[len(WIDTHS) :]
    z = _logits(model, docs, rows, held)
    model.scale = _platt(z, y[held])
    probable, told = model.probability(z), np.array([langs[i] or "" for i in held])
    for lang in {x for x in langs if x is not None}:  # on texts that the model was not trained on
        model.thresholds[lang] = _threshold(probable[told == lang], y[held][told == lang])
    return model


def _word_vectors(model: Model, rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    vectors = model.table[rows[words]].mean(axis=1)
    vectors[words == 0] = 0
    return vectors


def _logits(model: Model, docs, rows, which) -> np.ndarray:
    out = np.empty(len(which), dtype=np.float64)
    for i, d in enumerate(which):
        words, ids = np.unique(docs[d], return_inverse=True)
        pooled = responses(model.project(_word_vectors(model, rows, words)), ids).max(axis=0) + model.bias
        out[i] = model.logit(np.maximum(pooled, 0))
    return out


def _gradients(model: Model, docs, rows, y, batch, rng):
    words, ids = np.unique(np.concatenate([docs[d] for d in batch]), return_inverse=True)
    vectors = _word_vectors(model, rows, words)
    vectors[rng.random(len(words)) < 0.1] = 0  # word dropout
    projected = model.project(vectors)
    g_vec = np.zeros_like(vectors)
    g_filters = [np.zeros_like(f) for f in model.filters]
    g_bias, g_out, g_b, at = np.zeros_like(model.bias), np.zeros_like(model.out), 0.0, 0
    for d in batch:
        own = ids[at : at + len(docs[d])]
        at += len(docs[d])
        found = responses(projected, own)
        where = found.argmax(axis=0)
        raw = found[where, np.arange(found.shape[1])] + model.bias
        pooled = np.maximum(raw, 0)
        kept = rng.random(len(pooled)) < 0.8  # dropout of pooled features
        pooled = pooled * kept / 0.8
        error = 1 / (1 + np.exp(-np.clip(model.logit(pooled), -30, 30))) - y[d]
        g_b += error
        g_out += error * pooled
        g_raw = error * model.out * (raw > 0) * kept / 0.8
        g_bias += g_raw
        for w, (weights, grad, pos) in enumerate(zip(model.filters, g_filters, where.reshape(-1, FILTERS))):
            g = g_raw[w * FILTERS : (w + 1) * FILTERS]
            for k in range(len(weights)):
                word = own[pos + k]
                grad[k] += vectors[word].T * g
                np.add.at(g_vec, word, weights[k].T * g[:, None])
    n = len(batch)
    used = np.flatnonzero((g_vec != 0).any(axis=1) & (words != 0))
    flat = rows[words[used]].ravel()
    at_rows, inverse = np.unique(flat, return_inverse=True)
    g_table = np.zeros((len(at_rows), DIM), dtype=np.float32)
    np.add.at(g_table, inverse, np.repeat(g_vec[used] / FEATURES, FEATURES, axis=0) / n)
    return [(at_rows, g_table), *(g / n for g in g_filters), g_bias / n, g_out / n, g_b / n]


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic scale and shift of the logit, by Newton steps with a pull to the identity."""
    a, b = 1.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p)
        g = np.array([((p - y) * z).sum() + 4 * (a - 1), (p - y).sum() + 4 * b])
        h = np.array([[(w * z * z).sum() + 4, (w * z).sum()], [(w * z).sum(), w.sum() + 4]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
        a = max(a, 0.05)
    return float(a), float(b)


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Cut between 0.2 and 0.6 with the best F1, ties to the middle one; the default without positives."""
    if not y.sum():
        return THRESHOLD
    cuts = np.arange(20, 61, 5) / 100
    f1 = [2 * ((p >= c) & (y > 0)).sum() / (((p >= c).sum() + y.sum()) or 1) for c in cuts]
    top = [c for c, v in zip(cuts, f1) if v == max(f1)]
    return float(top[len(top) // 2])


class Scorer:
    """Scores texts with a bounded cache of word projections."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.ids: dict[str, int] = {"": 0}
        self.projected = np.zeros((1024, sum(WIDTHS) * FILTERS), dtype=np.float32)

    def _learn(self, words: list[str]) -> None:
        new = list(dict.fromkeys(w for w in words if w not in self.ids))
        start, end = len(self.ids), len(self.ids) + len(new)
        if end > len(self.projected):
            grown = np.zeros((max(end, 2 * len(self.projected)), self.projected.shape[1]), dtype=np.float32)
            grown[:start] = self.projected[:start]
            self.projected = grown
        rows = np.array([word_rows(w) for w in new], dtype=np.int64)
        self.projected[start:end] = self.model.project(self.model.table[rows].mean(axis=1))
        self.ids.update(zip(new, range(start, end)))

    def __call__(self, text: str) -> float:
        words = text.split()
        found = list(map(self.ids.get, words))
        if None in found:
            if len(self.ids) > CACHE_WORDS:
                self.reset()
            self._learn(words)
            found = list(map(self.ids.__getitem__, words))
        ids = np.array(found + [0] * max(WIDTHS), dtype=np.int64)
        pooled = np.full(len(WIDTHS) * FILTERS, -np.inf, dtype=np.float32)
        step = 4096
        for start in range(0, len(ids) - max(WIDTHS) + 1, step):
            part = ids[start : start + step + max(WIDTHS) - 1]
            pooled = np.maximum(pooled, responses(self.projected, part).max(axis=0))
        return float(self.model.probability(self.model.logit(np.maximum(pooled + self.model.bias, 0))))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple]:
    """At most ``rows`` of ``(doc_id, text, lang, toxic)`` outside the held-out fold, in a fixed order.

    Of rows that share an id one is taken, that with the smallest text, so the bound holds for any repetition.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold_of(F.col("doc_id")) != HELD_OUT_FOLD))
    one = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    said = docs.select("doc_id", F.struct(F.coalesce("text", F.lit("")).alias("text"), "lang").alias("said"))
    got = said.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("said").alias("said")).collect()
    return sorted((r["doc_id"], r["said"]["text"], r["said"]["lang"], r["toxic"]) for r in got)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    got = training_rows(docs, labels)
    return train([r[1] for r in got], [r[3] for r in got], [r[2] for r in got])


ARROW = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("toxic", pa.bool_())]
)
#: The scorer of this Python worker, with its cache, by model.
_WORKER: dict[str, Scorer] = {}


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted, toxic``; ``toxic`` uses the language's threshold."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def setup():
        score = _WORKER.get(name)
        if score is None:
            _WORKER.clear()
            score = _WORKER[name] = Scorer(shared.value)

        def process(cols):
            out = []
            for doc_id, text, lang in zip(*cols):
                p = score(text or "")
                held = doc_id is not None and fold_of_value(doc_id) == HELD_OUT_FOLD
                cut = score.model.thresholds.get(lang, THRESHOLD)
                out.append((doc_id, held, p, int(p >= THRESHOLD), p >= cut))
            return out

        return process

    return map_rows(
        docs, ["doc_id", "text", "lang"], "doc_id long, held_out boolean, score double, predicted int, toxic boolean",
        ARROW, setup,
    )


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, unchanged and without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = Scorer(shared.value)
        for batch in batches:
            texts, langs = batch.column("text"), batch.column("lang")
            keep = [
                score(t.as_py() or "") < score.model.thresholds.get(x.as_py(), THRESHOLD) for t, x in zip(texts, langs)
            ]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
