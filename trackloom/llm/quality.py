"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed byte n-grams, and of the equality patterns of four words in a row (by how often they
occur), which show repetition whatever the words are. Each is scaled by its class log-count ratio, rows are normalised, and a
linear hinge-loss model is fitted by dual coordinate descent. Margins become probabilities by a logistic curve that is
fitted on rows which the descent didn't see (the ratios count all labelled rows). The patterns are no n-grams of characters;
they are scaled and weighted like them.

The model is fitted on a bounded sample: about ``SAMPLE`` labelled rows, those of smallest hash.

Edge cases: a null text counts as empty; an empty text has no features and is scored by the bias; if all labels agree, or
there are none, the score is the (smoothed) share of label 1; null labels are left out; several labels of a document all
count; repeated rows each get their row; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, utf8
from .ngrams import codes

BITS, SIZES = 16, (1, 2, 3, 4)
SAMPLE, EPOCHS, COST = 4096, 12, 1.0


def features(text: bytes) -> np.ndarray:
    """Sorted indices of the n-grams that occur."""
    seen = np.zeros(1 << BITS, bool)
    for n in SIZES:
        seen[codes(text, n, BITS)] = True
    w = np.fromiter(map(hash, text.split()), np.int64)
    m = len(w) - 3
    if m > 0:
        pattern = np.zeros(m, np.int64)
        for bit, (i, j) in enumerate(combinations(range(4), 2)):
            pattern |= (w[i : i + m] == w[j : j + m]).astype(np.int64) << bit
        times = np.bincount(pattern, minlength=64)
        for p in np.flatnonzero(times[1:]) + 1:
            share = min(4, int(-np.log2(times[p] / m)))
            seen[codes(b"words%c%c" % (int(p), share), 7, BITS)] = True
    return np.flatnonzero(seen)


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed indicator counts of label 1 to those of label 0."""
    counts = np.ones((2, 1 << BITS))
    for x, label in zip(rows, y, strict=True):
        counts[label, x] += 1
    share = counts / counts.sum(1, keepdims=True)
    return np.log(share[1] / share[0])


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2/2 + sum of cost * hinge, by dual coordinate descent; classes weigh alike in total."""
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.array([(y == 0).mean(), (y == 1).mean()])
    cost = COST * 0.5 / share[y]
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    square = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * (w[rows[i]] @ values[i] + bias) - 1
            fresh = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if fresh != alpha[i]:
                step = (fresh - alpha[i]) * sign[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = fresh
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1, by damped Newton steps on smoothed targets."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
    theta, x = np.array([1.0, 0.0]), np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta -= np.clip(np.linalg.solve(hessian, x.T @ (p - t) + 1e-3 * theta), -2, 2)
    return float(max(theta[0], 0.0)), float(theta[1])


@dataclass
class Model:
    weights: np.ndarray
    ratio: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, x: np.ndarray) -> float:
        v = self.ratio[x]
        norm = np.sqrt(v @ v)
        return float(self.weights[x] @ v / norm if norm else 0.0) + self.bias

    def score(self, text: bytes) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.slope * self.margin(features(text)) + self.offset, -30, 30))))


def train(rows: list[np.ndarray], y: np.ndarray) -> Model:
    size = 1 << BITS
    if len(set(y.tolist())) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(size), np.zeros(size), 0.0, 0.0, float(np.log(p / (1 - p))))
    ratio = ratios(rows, y)
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    scaled = [ratio[x] / max(float(np.linalg.norm(ratio[x])), 1e-12) for x in rows]
    own = np.flatnonzero(~held)
    w, bias = descend([rows[i] for i in own], [scaled[i] for i in own], y[own])
    model = Model(w, ratio, bias, 1.0, 0.0)
    at = np.flatnonzero(held) if held.any() else own
    model.slope, model.offset = logistic(np.array([model.margin(rows[i]) for i in at]), y[at])
    return model


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learns from the labelled documents; the caller leaves out what is held out."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    n = known.count()
    some = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30)))  # about SAMPLE rows
    both = docs.select(F.col(doc_id).alias("id"), utf8(text).alias("text")).join(F.broadcast(some), "id")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [features(t).astype("<i4").tobytes() for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["h", "label", "x"])

    got = map_slices(both.select(F.xxhash64("id").alias("h"), "label", "text"), fn, "h long, label int, x binary").collect()
    got.sort(key=lambda r: (r["h"], r["label"], r["x"]))
    return train([np.frombuffer(r["x"], "<i4") for r in got], np.array([r["label"] for r in got], int))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score for every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # size fixed by BITS

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        one = shipped.value.score
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    return map_slices(docs.select(F.col(doc_id), utf8(text).alias("text")), fn, f"doc_id {kind}, score double")
