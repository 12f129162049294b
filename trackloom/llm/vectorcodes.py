"""Vector code compression: weighted distinct parts, weighted Lloyd over them, codes and errors joined back.

A component x becomes the integer floor(4096 * x); a vector is cut into ``PARTS`` equal consecutive parts. Each part position
has a codebook of ``ENTRIES`` entries, which starts as that part of the vectors of smallest id. A round assigns every part to
the nearest entry (squared distance, ties to the lower index) and replaces an entry by its parts' componentwise
floor(sum / count); unused entries stay. After the last round the parts are assigned once more.

1. Equal parts of a position become one distinct row with a weight, counted before the shuffle.
2. A round is one pass over the distinct rows. A task adds up weights and weighted sums by entry and returns those alone: a
   codebook's worth of numbers, however many rows it read. Sums are exact, as limbs of 32 bits, so they can't overflow.
3. Codes and distances of the distinct rows are joined back to the parts of each vector; parts that a thousandth of all rows
   or more have are broadcast (a thousand at most), so that copies of one vector don't gather in one task.

Edge cases: rows whose vector is null, empty or holds null or non-finite components (before or after the factor 4096) are
dropped, as are those whose length is not a multiple of ``PARTS`` or differs from the most common such length (ties: the
shorter). Rows that share an id, repeat or have none are rows of their own; a null id sorts last; ids that tie start a codebook
in order of their vectors. Fewer than ``ENTRIES`` kept rows make codebooks of as many entries. An error that no long can hold
is null, and so is a sum that contains it. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, spread_join

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components below this are multiplied in 64 bits: a part of 8 to 64 of them has a squared distance below 2^63.
_SMALL = float(1 << 27)
_LIMB, _LONG = 1 << 32, 1 << 63


def integers(v: np.ndarray) -> np.ndarray:
    """Whole numbers, held as doubles, in 64-bit integers or, where those could overflow, in Python's."""
    if not v.size or np.abs(v).max() < _SMALL and v.shape[-1] <= 64:
        return v.astype(np.int64)
    return np.array([int(x) for x in v.ravel()], object).reshape(v.shape)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of ``book`` to each row of ``x``; ties go to the lower index."""
    if book.dtype == object or x.dtype == object:
        x, book = x.astype(object), book.astype(object)
    d = np.stack([((x - e) ** 2).sum(axis=1) for e in book], axis=1)
    code = d.argmin(axis=1)
    return code, d[np.arange(len(x)), code]


def limbs(value: int) -> list[int]:
    """value = sum of limb k times 2^(32 k); all but the last are from 0 to 2^32 - 1."""
    out = []
    while not -_LONG <= value < _LONG:
        out.append(value % _LIMB)
        value >>= 32
    return [*out, value % _LIMB, value >> 32]


def _cut(vectors: DataFrame, dims: int) -> DataFrame:
    """A row per vector and position: row, its columns, and part (the position's byte, then the integers as doubles)."""
    width = dims // PARTS

    def fn(batches):
        for b in batches:
            n = b.num_rows
            v = np.floor(np.asarray(b.column("v").flatten()).reshape(n, dims) * SCALE) + 0.0
            rows = [bytes([p]) + v[i, p * width : (p + 1) * width].tobytes() for i in range(n) for p in range(PARTS)]
            at = pa.array(np.repeat(np.arange(n, dtype=np.int32), PARTS))
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in ("row", "vec_id", "label")], pa.array(rows, pa.binary())], names=["row", "vec_id", "label", "part"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.mapInArrow(fn, f"row bigint, vec_id {kinds['vec_id']}, label {kinds['label']}, part binary")


def _assigned(batch: pa.RecordBatch, books: list[np.ndarray]):
    """(position, rows of the batch, their integers, codes, distances) for each position in the batch."""
    raw = batch.column("part").to_pylist()
    where = np.frombuffer(b"".join([r[:1] for r in raw]), np.uint8)
    x = integers(np.frombuffer(b"".join([r[1:] for r in raw]), np.float64).reshape(len(raw), -1))
    for p in np.unique(where).tolist():
        own = np.flatnonzero(where == p)
        yield p, own, x[own], *nearest(x[own], books[p])


def _round(distinct: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round of weighted Lloyd."""
    width = books[0].shape[1]

    def fn(batches):
        total: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0] * (width + 1))
        for b in batches:
            held = np.asarray(b.column("held"))
            for p, own, x, code, _ in _assigned(b, books):
                big = x.dtype == object or int(np.abs(x).max()) * int(held[own].sum()) >= _LONG
                w = held[own].astype(object if big else np.int64)
                for e in np.unique(code).tolist():
                    mine = code == e
                    sums = (x[mine] * w[mine, None]).sum(axis=0).tolist()
                    total[p, e] = [a + b for a, b in zip(total[p, e], [int(w[mine].sum()), *sums], strict=True)]
        rows = [(p, e, c, k, limb) for (p, e), sums in total.items() for c, s in enumerate(sums) for k, limb in enumerate(limbs(int(s)))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["p", "e", "c", "k", "limb"])

    sums: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0] * (width + 1))
    # PARTS x ENTRIES x (width + 1) sums of a few limbs each, whatever the table's size.
    for r in distinct.mapInArrow(fn, "p long, e long, c long, k long, limb long").groupBy("p", "e", "c", "k").agg(F.sum("limb").alias("limb")).collect():
        sums[r["p"], r["e"]][r["c"]] += r["limb"] << 32 * r["k"]
    out = []
    for p, book in enumerate(books):
        entries = [[s // sums[p, e][0] for s in sums[p, e][1:]] if (p, e) in sums else book[e].tolist() for e in range(len(book))]
        out.append(integers(np.array(entries, object).astype(np.float64)) if all(abs(x) < _SMALL for e in entries for x in e) else np.array(entries, object))
    return out


def _coded(distinct: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """The distinct rows with code and error (null: beyond a long)."""

    def fn(batches):
        for b in batches:
            code, error = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, object)
            for _, own, _, c, d in _assigned(b, books):
                code[own], error[own] = c, d
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("held"), pa.array(code), pa.array([int(e) if e < _LONG else None for e in error], pa.int64())], names=["part", "held", "code", "error"])

    return distinct.mapInArrow(fn, "part binary, held long, code int, error long")


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all integers by part, entry and position within the part, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for entry in book for x in entry).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(row, vec_id, label, codes array<int>, error) for every kept row, and the final codebooks, one per part position."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "codes")
    v = F.col("v")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) < float("inf")))
    kept = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v")).filter(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % PARTS == 0)).filter(whole)
    dims = kept.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
    names = "row long, vec_id {}, label {}, codes array<int>, error long".format(*[kept.schema[c].dataType.simpleString() for c in ("vec_id", "label")])
    if dims is None:
        return spark.createDataFrame([], names), []
    kept = kept.filter(F.size(v) == dims["d"]).withColumn("row", F.monotonically_increasing_id())
    parts = scratch.write(_cut(kept, dims["d"]))  # once written, a row keeps its number
    distinct = scratch.write(parts.groupBy("part").agg(F.count(F.lit(1)).alias("held")))
    first = kept.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    start = integers(np.floor(np.array([r["v"] for r in first]) * SCALE) + 0.0)
    books = list(np.split(start, PARTS, axis=1))
    for _ in range(ROUNDS):
        books = _round(distinct, books)
    coded = scratch.write(_coded(distinct, books))
    total = dims["count"] * PARTS
    back = spread_join(parts, coded, "part", "held", total).select("row", "vec_id", "label", F.conv(F.hex(F.substring("part", 1, 1)), 16, 10).cast("int").alias("p"), "code", "error")
    codes = F.transform(F.array_sort(F.collect_list(F.struct("p", "code"))), lambda x: x["code"])  # PARTS of them
    error = F.when(F.count("error") == PARTS, F.try_sum("error"))
    return scratch.write(back.groupBy("row", "vec_id", "label").agg(codes.alias("codes"), error.alias("error"))), books


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error: the error summed over equal labels, nulls together (null: beyond a long)."""
    spelled = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    named = coded.withColumn("name", spelled)
    n = F.count(F.lit(1))
    sums = named.groupBy("name").agg(n.alias("held"), F.when(F.count("error") == n, F.try_sum("error")).alias("label_error"))
    return spread_join(named, sums, "name", "held", coded.count()).drop("name")
