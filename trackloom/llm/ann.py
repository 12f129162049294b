"""Maximum inner product search: anisotropic four-bit codes, table scans, exact reranking.

Every coordinate gets a 16-entry codebook, fitted on a bounded sample under the score-aware loss, which weighs the part of
the residual parallel to the vector more than the rest. All rows are coded (two codes a byte, and the norm of the
residual). A query's scan sums table entries; a row is reranked in double precision unless its scanned score plus
``|query| * |residual|``, which its true score can't exceed, stays below the k-th lower bound. So the answer is exact.
Queries and candidates meet in cells of bounded size.

Vectors and queries are first brought near norm one by powers of two, so that no size of their components spoils the tables.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, as query or candidate;
neither do rows without an id, nor those whose length differs from the most common one; a query's own row is no neighbour
of it, but another row of its id is; equal rows among the queries are one query with one answer, rows that share an id but
not the vector are queries of their own; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Rows that the codebooks are fitted on, at most about so many.
SAMPLE = 8192
#: Weight of the squared parallel residual over that of the rest: (d - 1) T^2 / (1 - T^2) for T = 0.2, d = 64.
PARALLEL = 2.6
BLOCK, QUERIES = 8192, 2048


def fit(x: np.ndarray, rounds: int = 6) -> np.ndarray:
    """(dims, 16) codebooks, by turns of anisotropic assignment and closed-form update."""
    books = np.quantile(x, (np.arange(16) + 0.5) / 16, axis=0).T.copy()
    norm2 = np.maximum((x * x).sum(1), 1e-30)
    for _ in range(rounds):
        codes, _ = assign(x, books, 1)
        kept = np.take_along_axis(books, codes.T, axis=1).T
        along = ((x - kept) * x).sum(1)
        for m in range(x.shape[1]):
            v, c = x[:, m], codes[:, m]
            others = along - (v - kept[:, m]) * v
            weight = 1 + PARALLEL * v * v / norm2
            target = v + PARALLEL * (others + v * v) * v / norm2
            total = np.bincount(c, weight, 16)
            books[m] = np.where(total > 0, np.bincount(c, target, 16) / np.maximum(total, 1e-30), books[m])
    return np.sort(books, axis=1)


def assign(x: np.ndarray, books: np.ndarray, sweeps: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Codes by coordinate descent on the anisotropic loss, and the residual norms."""
    codes = np.stack([np.abs(x[:, m, None] - books[m]).argmin(1) for m in range(x.shape[1])], axis=1)
    norm2 = np.maximum((x * x).sum(1), 1e-30)
    kept = np.take_along_axis(books, codes.T, axis=1).T
    along = ((x - kept) * x).sum(1)
    for _ in range(sweeps):
        for m in range(x.shape[1]):
            v = x[:, m]
            rest = along - (v - kept[:, m]) * v
            r = v[:, None] - books[m]
            loss = r * r + PARALLEL * (rest[:, None] + r * v[:, None]) ** 2 / norm2[:, None]
            codes[:, m] = loss.argmin(1)
            kept[:, m] = books[m][codes[:, m]]
            along = rest + (v - kept[:, m]) * v
    return codes, np.sqrt(((x - kept) ** 2).sum(1))


def pack(codes: np.ndarray) -> np.ndarray:
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), codes.dtype)], axis=1)
    return (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by the power of two that brings their norms near one, and its exponents: no square over- or underflows."""
    first = np.frexp(np.abs(x).max(axis=1))[1]
    y = np.ldexp(x, -first[:, None])
    second = np.round(np.log2(np.sqrt((y * y).sum(axis=1)))).astype(first.dtype)
    return np.ldexp(y, -second[:, None]), first + second


def tables(query: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(bytes, 256) sums of table entries for each pair of four-bit codes."""
    one = query[:, None] * books
    if len(one) % 2:
        one = np.concatenate([one, np.zeros((1, 16))])
    return (one[1::2, :, None] + one[::2, None, :]).reshape(-1, 256).astype(np.float32)


def search(qid: np.ndarray, number: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, packed: np.ndarray, residual: np.ndarray, scale: np.ndarray, books: np.ndarray, k: int):
    """Exact top k of the candidates for each query: (query, its number, id, score) arrays. All rows of an id are among the candidates, or none."""
    order = np.argsort(ids, kind="stable")
    ids, x, packed, residual, scale = ids[order], x[order], packed[order], residual[order], scale[order]
    near_one, q_scale = scaled(q) if len(q) else (q, np.zeros(0, int))
    tiny = 4 * x.shape[1] * 5e-324  # what sums of products lose below the least normal number
    columns = np.ascontiguousarray(packed.T)
    out = []
    for i, own in enumerate(qid):
        table = tables(near_one[i], books)
        scanned = np.zeros(len(ids), np.float32)
        for m, codes in enumerate(columns):
            scanned += table[m][codes]
        # Codes miss the residual; sums of table entries, in single precision, a millionth of the norms' product for each entry or so.
        slack = np.linalg.norm(near_one[i]) * (residual + 1e-5 * (2 + residual))
        scanned, slack = np.ldexp(scanned.astype(float), scale + q_scale[i]), np.ldexp(slack, scale + q_scale[i]) + tiny
        others = np.ones(len(ids), bool)
        same = np.flatnonzero(ids == own)
        others[same[(x[same] == q[i]).all(1)][:1]] = False  # the query's own row
        if not others.any():
            continue
        with np.errstate(over="ignore", invalid="ignore"):
            lower, upper = scanned - slack, scanned + slack
            lower[~others | np.isnan(lower)], upper[np.isnan(upper)] = -np.inf, np.inf  # beyond a double: reranked
            bound = np.partition(lower, -k)[-k] if len(lower) > k else -np.inf
            take = np.flatnonzero(others & (upper >= bound))
            score = np.cumsum(x[take] * q[i], axis=1)[:, -1]  # summed in order, so alike on every machine
        best = np.lexsort((ids[take], -score))[:k]
        out.append((np.full(len(best), own), np.full(len(best), number[i]), ids[take][best], score[best]))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row where ``is_query`` holds, the k other rows of largest inner product."""
    spark = vectors.sparkSession
    v = F.col(embedding).cast("array<double>")
    clean = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    )
    dims = clean.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    clean = clean.filter(F.size("v") == dims["d"])
    n = dims["count"]
    share = min(1.0, SAMPLE / n)
    sample = clean.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    books = fit(scaled(np.array([r["v"] for r in sample.select("v").collect()] or [clean.first()["v"]]))[0])

    def code(batches):
        for b in batches:
            x = _matrix(b.column("v"))
            if len(x):
                y, scale = scaled(x)
                codes, residual = assign(y, books)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array([r.tobytes() for r in pack(codes)], pa.binary()), pa.array(residual), pa.array(scale, pa.int32())], names=["id", "v", "codes", "residual", "scale"])

    coded = Scratch(spark, "ann").write(clean.mapInArrow(code, "id long, v array<double>, codes binary, residual double, scale int"))
    asked = coded.filter(is_query(F.col("id"))).select("id", "v").distinct()
    asked = asked.withColumn("number", F.row_number().over(Window.partitionBy("id").orderBy("v")).cast("long"))
    blocks, parts = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(asked.count() / QUERIES))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = coded.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    right = asked.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int")).withColumn("block", every(blocks))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["query_id", "number", "vec_id", "score"]
        if not a.num_rows or not b.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())], names=names)
        packed = np.frombuffer(b"".join(a.column("codes").to_pylist()), np.uint8).reshape(a.num_rows, -1)
        found = search(np.asarray(b.column("id")), np.asarray(b.column("number")), _matrix(b.column("v")), np.asarray(a.column("id")), _matrix(a.column("v")), packed, np.asarray(a.column("residual")), np.asarray(a.column("scale")), books, k)
        return pa.Table.from_arrays([pa.array(c) for c in found], names=names)

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(cell, "query_id long, number long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "number").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
