"""Quality classifier learned from trusted positives and unlabelled text.

A small network minimises the non-negative unbiased risk: positives count with the class prior, and
unlabelled text stands for the negatives after the positives' share is taken off, never below zero.
The prior is estimated first, as the least ratio of unlabelled to positive mass in the top bins of
a plain positive-against-unlabelled classifier.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skylattice.llm.buffers import chunks, flat, lower, spans, word_hashes

#: Rows the classifier is fitted on.
POSITIVE_ROWS = 8000
UNLABELLED_ROWS = 16000

_PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASSES = len(_PUNCTUATION) + 7
_CLASS = np.full(256, _CLASSES - 1, np.uint8)  # non-ASCII
_CLASS[:128] = _CLASSES - 2  # control
for _i, _c in enumerate(_PUNCTUATION):
    _CLASS[_c] = _i
for _i, _range in enumerate([range(65, 91), range(97, 123), range(48, 58), [32], [10]]):
    _CLASS[list(_range)] = len(_PUNCTUATION) + _i
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Number of different hashes in each row; `rows` ascend."""
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return np.bincount(r[new], minlength=n)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row: shares of byte classes; word, pair and line repetition; lengths."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(n, dtype=np.int64) * _CLASSES, sizes)
    shares = np.bincount(row + _CLASS[data], minlength=n * _CLASSES).reshape(n, _CLASSES)
    shares = np.sqrt(shares / np.maximum(sizes, 1)[:, None])
    low = lower(data)
    starts, ends, rows = spans(low, offsets)
    hashes = word_hashes(low, starts, ends)
    words = np.bincount(rows, minlength=n)
    per_word = 1 / np.maximum(words, 1)
    letters = np.bincount(rows, weights=ends - starts, minlength=n) * per_word
    same = rows[1:] == rows[:-1]
    twice = np.bincount(rows[1:][same & (hashes[1:] == hashes[:-1])], minlength=n) * per_word
    pairs = (hashes[1:] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[:-1])[same]
    pair_rows = rows[1:][same]
    per_pair = 1 / np.maximum(np.bincount(pair_rows, minlength=n), 1)
    line_starts, line_ends, line_rows = spans(low, offsets, _NEWLINE)
    lines = np.bincount(line_rows, minlength=n)
    line_hashes = word_hashes(low, line_starts, line_ends)
    columns = [
        np.log1p(sizes), np.log1p(words), letters, twice,
        _distinct(rows, hashes, n) * per_word,
        _distinct(pair_rows, pairs, n) * per_pair,
        _distinct(line_rows, line_hashes, n) / np.maximum(lines, 1),
        np.log1p(lines), lines * per_word,
    ]
    return np.column_stack([shares, *columns]).astype(np.float32)


FEATURES = _CLASSES + 9


class Network:
    """One hidden layer; fitted by Adam on minibatches, from a fixed seed."""

    def __init__(self, x: np.ndarray, hidden: int = 16, seed: int = 11):
        self.rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.parts = [
            (self.rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1])).astype(np.float32),
            np.zeros(hidden, np.float32),
            (self.rng.standard_normal(hidden) / np.sqrt(hidden)).astype(np.float32),
            np.zeros(1, np.float32)]
        self.first = [np.zeros_like(p) for p in self.parts]
        self.second = [np.zeros_like(p) for p in self.parts]
        self.steps = 0

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.parts
        return np.tanh(self._scaled(x) @ w + b) @ v + c[0]

    def push(self, x: np.ndarray, pull: np.ndarray, rate: float, decay: float) -> None:
        """One step against `pull`, the derivative of the risk by each row's margin."""
        w, b, v, _ = self.parts
        z = self._scaled(x)
        h = np.tanh(z @ w + b)
        back = (pull[:, None] * v) * (1 - h * h)
        grads = [z.T @ back + decay * w, back.sum(axis=0), h.T @ pull + decay * v,
                 np.array([pull.sum()])]
        self.steps += 1
        for i, g in enumerate(grads):
            self.first[i] = 0.9 * self.first[i] + 0.1 * g
            self.second[i] = 0.99 * self.second[i] + 0.01 * g * g
            up = self.first[i] / (1 - 0.9 ** self.steps)
            down = np.sqrt(self.second[i] / (1 - 0.99 ** self.steps)) + 1e-7
            self.parts[i] = self.parts[i] - (rate * up / down).astype(np.float32)


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -40, 40)))


def _epochs(net: Network, positive: np.ndarray, unlabelled: np.ndarray, epochs: int, rate: float,
            pull_of, batch: int = 512) -> None:
    steps = max(1, -(-max(len(positive), len(unlabelled)) // batch))
    for _ in range(epochs):
        p_order = net.rng.permutation(len(positive))
        u_order = net.rng.permutation(len(unlabelled))
        for p, u in zip(np.array_split(np.resize(p_order, max(len(p_order), steps)), steps),
                        np.array_split(np.resize(u_order, max(len(u_order), steps)), steps)):
            x = np.concatenate([positive[p], unlabelled[u]])
            net.push(x, pull_of(net.margin(x), len(p)), rate, 1e-4)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives in the unlabelled rows. Half of each trains a classifier; on the other
    half, the least ratio of the two shares above any threshold bounds the prior from above."""
    if min(len(positive), len(unlabelled)) < 8:
        return 0.5
    net = Network(np.concatenate([positive, unlabelled]))

    def apart(m, p):
        s = _sigmoid(m)
        return np.concatenate([(s[:p] - 1) / p, s[p:] / max(len(m) - p, 1)])

    _epochs(net, positive[::2], unlabelled[::2], 20, 0.005, apart)
    p, u = np.sort(net.margin(positive[1::2])), np.sort(net.margin(unlabelled[1::2]))
    cuts = np.unique(p)
    above_p = 1 - np.searchsorted(p, cuts) / len(p)
    above_u = 1 - np.searchsorted(u, cuts) / len(u)
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = int(np.argmin((above_u + slack) / np.maximum(above_p, 1e-9)))
    return float(np.clip(above_u[best] / max(above_p[best], 1e-9), 0.01, 0.99))


def fit_network(positive: np.ndarray, unlabelled: np.ndarray, prior: float,
                epochs: int = 40) -> Network:
    """Minimises prior x R+(P) + max(0, R-(U) - prior x R-(P)) with the logistic loss; a batch whose
    negative part falls below zero is pushed the other way."""
    net = Network(np.concatenate([positive, unlabelled]))

    def pull(m, p):
        s = _sigmoid(m)
        up, un = max(p, 1), max(len(m) - p, 1)
        negative = np.logaddexp(0, m[p:]).sum() / un - prior * np.logaddexp(0, m[:p]).sum() / up
        of_negative = np.concatenate([-prior * s[:p] / up, s[p:] / un])
        if negative < 0:
            return -of_negative
        of_positive = np.concatenate([prior * (s[:p] - 1) / up, np.zeros(len(m) - p)])
        return of_positive + of_negative

    _epochs(net, positive, unlabelled, epochs, 0.003, pull)
    return net


def _rows(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, most: int) -> np.ndarray:
    """Features of at most `most` rows of the chosen ids, in the order of their text hashes. Rows equal
    in id and text are one; an id that has more rows than fit gives those with the smallest hashes."""
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    of = keyed.join(F.broadcast(ids), F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    keys = of.select("id", "h").distinct().orderBy(F.xxhash64("id"), "id", "h").limit(most).select(
        F.col("id").alias("_id"), F.col("h").alias("_h"))
    picked = (keyed.join(F.broadcast(keys), F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")),
                         "left_semi").groupBy("id", "h").agg(F.first("text").alias("text")))

    def computed(batches):
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b, part, ends in chunks(data, offsets):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a),
                     pa.array([r.tobytes() for r in features(part, ends)], pa.binary())],
                    names=["h", "x"])

    found = picked.select("h", "text").mapInArrow(
        computed, "h long, x binary").toPandas().sort_values("h", kind="stable")
    if not len(found):
        return np.zeros((0, FEATURES), np.float32)
    return np.frombuffer(b"".join(found["x"]), np.float32).reshape(-1, FEATURES)


def fit_quality(docs: DataFrame, labels: DataFrame, *, training: Column, id_col: str = "doc_id",
                text_col: str = "text", label_col: str = "quality",
                positive_rows: int = POSITIVE_ROWS,
                unlabelled_rows: int = UNLABELLED_ROWS) -> dict:
    """Network and prior from documents that every label calls 1, and documents without a label.

    Both are the first so many training rows by a hash of the id. Labels of 0 are not used. With
    no positives or nothing unlabelled there is no network, and every score is the prior."""
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.min(label_col).alias("_mark"))
    ids = docs.where(training).select(F.col(id_col).alias("_doc"))
    marked = ids.join(marks, F.col("_doc") == F.col("_id"), "left").select(
        F.col("_doc").alias("_id"), "_mark").distinct()

    def first(rows: DataFrame, n: int) -> DataFrame:
        return rows.select("_id").orderBy(F.xxhash64("_id"), "_id").limit(n)

    positive = _rows(docs, first(marked.where("_mark = 1"), positive_rows), id_col, text_col, positive_rows)
    unlabelled = _rows(docs, first(marked.where("_mark IS NULL"), unlabelled_rows), id_col, text_col, unlabelled_rows)
    if not len(positive) or not len(unlabelled):
        return {"prior": 0.5, "net": None}
    prior = estimate_prior(positive, unlabelled)
    return {"prior": prior, "net": fit_network(positive, unlabelled, prior)}


def score_quality(docs: DataFrame, model: dict, *, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(id, score) of every row; a null text counts as empty, and an empty text is scored like any
    other. Rows are not moved. A chunk of texts is one matrix; a text is never cut."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def scored(batches):
        m = shared.value
        for batch in batches:
            data, offsets = flat(batch.column(1))
            score = np.full(batch.num_rows, m["prior"])
            if m["net"] is not None:
                for a, b, part, ends in chunks(data, offsets):
                    score[a:b] = _sigmoid(m["net"].margin(features(part, ends)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score, pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(scored, f"`{id_col}` {id_type}, score double")
