"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of hashed byte n-grams (lower-cased, punctuation blanked, without tokens that hold
a digit or an @: addresses, numbers and keys are in no language; a text of such tokens only keeps them). Each language has
several centroids, clustered by spherical k-means; a text gets the language of the centroid of largest cosine. Texts whose cosine to every
centroid is below the limit of the language found are flagged as rejected. The limit is ``MARGIN`` times the least cosine
of the language's learned texts (the ``LOW``th percentile, each text left out of its own centroid). Cosines of short texts
are smaller, about as the root of their number of distinct n-grams, so limits are lowered by it below ``FULL`` n-grams.

The centroids are fitted on a bounded sample: about ``SAMPLE`` labelled rows of each language, those of smallest hash.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, and rejected; equal cosines go to the
alphabetically first language; null or extra columns don't matter; repeated rows each get their row; with nothing to
learn from, every text is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices
from .ngrams import codes

BITS, SIZES = 13, (1, 2, 3)
SAMPLE, CLUSTERS, ROUNDS = 400, 4, 8
#: Percentile of the learned texts' cosines, the share of it that is the limit, and the distinct n-grams from which it is whole.
LOW, MARGIN, FULL = 0.25, 0.75, 128
_LETTER = regex.compile(r"\p{L}")


#: Bytes of ASCII other than letters become spaces, whose runs then count once.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


#: Tokens with a digit or an @, found from their starts only.
_CODED = re.compile(rb"(?<![^\x20\x09-\x0d])(?=[^\x20\x09-\x0d0-9@]*[0-9@])[^\x20\x09-\x0d]+")


def term_counts(text: str) -> np.ndarray:
    raw = text.lower().encode()
    plain = _CODED.sub(b" ", raw).translate(_LETTERS).split() or raw.translate(_LETTERS).split()
    raw = b" %b " % b" ".join(plain)
    return np.bincount(np.concatenate([codes(raw, n, BITS) for n in SIZES]), minlength=1 << BITS)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    limits: np.ndarray

    def vectors(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), 1 << BITS), np.float32)
        for i, t in enumerate(texts):
            x[i] = np.log1p(term_counts(t))
        return _unit(x * self.idf)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        known = [i for i, t in enumerate(texts) if t is not None and _LETTER.search(t)] if self.langs else []
        lang, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        for at in range(0, len(known), 64):
            part = known[at : at + 64]
            x = self.vectors([texts[i] for i in part])
            cosine = x @ self.centroids.T
            best = cosine.argmax(1)
            low = self.limits[self.owner[best]] * _fullness(x)
            for i, b, c, l in zip(part, best, cosine[np.arange(len(part)), best], low, strict=True):
                lang[i], score[i], rejected[i] = self.langs[self.owner[b]], min(1.0, max(0.0, float(c))), c < l
        return lang, score, rejected


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _fullness(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.minimum(1, (x > 0).sum(1) / FULL))


def limit(x: np.ndarray, c: np.ndarray) -> float:
    """The cosine below which a text is rejected, from the learned texts of a language and its centroids."""
    cosine = x @ c.T
    near = cosine.argmax(1)
    others = np.stack([x[near == j].sum(0) for j in range(len(c))])[near] - x
    cosine[np.arange(len(x)), near] = (x * _unit(others)).sum(1)
    return MARGIN * float(np.percentile(cosine.max(1) / np.maximum(_fullness(x), 1e-12), LOW, method="lower"))


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; at most k unit centroids."""
    seeds = [int((x @ x.mean(0)).argmax())]
    while len(seeds) < min(k, len(x)):
        seeds.append(int((x @ x[seeds].T).max(1).argmin()))
    c = x[seeds]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(1)
        c = _unit(np.stack([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))]))
    return c


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from the rows of ``labelled`` that have a text and a language."""
    rows = labelled.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    order = F.pmod(F.xxhash64(F.col("id")), F.lit(1 << 30)) / (1 << 30)
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, F.lit(SAMPLE / n)).otherwise(share)
    sample = rows.filter((order < share) & F.col("text").isNotNull())

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        full = [term_counts(t) for t in batch.column(0).to_pylist()]
        index = [np.flatnonzero(c) for c in full]
        return pa.RecordBatch.from_arrays(
            [batch.column(1), batch.column(2), pa.array([i.astype("<i4").tobytes() for i in index], pa.binary()), pa.array([c[i].astype("<i4").tobytes() for c, i in zip(full, index, strict=True)], pa.binary())],
            names=["lang", "id", "i", "n"],
        )

    got = sorted(map_slices(sample.select("text", "lang", F.xxhash64("id").alias("id")), fn, "lang string, id long, i binary, n binary").collect(), key=lambda r: (r["lang"], r["id"], r["i"], r["n"]))
    got = [r for r in got if r["i"]]
    langs = sorted({r["lang"] for r in got})
    x = np.zeros((len(got), 1 << BITS), np.float32)
    for k, r in enumerate(got):
        x[k, np.frombuffer(r["i"], "<i4")] = np.log1p(np.frombuffer(r["n"], "<i4"))
    idf = (np.log((1 + len(got)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    x = _unit(x * idf)
    of = np.array([langs.index(r["lang"]) for r in got], int)
    parts = [cluster(x[of == i], CLUSTERS) for i in range(len(langs))]
    owner = np.repeat(np.arange(len(langs)), [len(p) for p in parts])
    limits = np.array([limit(x[of == i], p) for i, p in enumerate(parts)])
    return Model(langs, idf, np.concatenate(parts) if parts else np.zeros((0, 1 << BITS), np.float32), owner, limits)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and rejected to ``docs``; columns of these names are replaced."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # size fixed by BITS, CLUSTERS and the languages
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in renamed.schema.fields)
    at = keep.index(text)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, rejected = shipped.value.predict(batch.column(at).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang), pa.array(score), pa.array(rejected)], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    out = map_slices(renamed, fn, f"{types}, lang_pred string, score double, rejected boolean")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "rejected")
