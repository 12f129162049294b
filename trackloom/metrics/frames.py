"""Accuracy over DataFrames: pair tables, grouped kernels, final scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.pairs import frame_pairs
from .kernels import BY_FRAME, Passing, Sequence

#: Rows of a batch that a kernel gives.
ROWS = 1 << 14
KINDS = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}


def sides(gt: DataFrame, trk: DataFrame) -> DataFrame:
    """seq, frame, gid, tid, sim: overlapping pairs, and every box once by itself, so that frames of one side count."""
    pairs = frame_pairs(gt, trk, touching=True)
    own = gt.select("seq", "frame", F.col("id").alias("gid"), F.lit(None).cast("long").alias("tid"), F.lit(None).cast("double").alias("sim"))
    other = trk.select("seq", "frame", F.lit(None).cast("long").alias("gid"), F.col("id").alias("tid"), F.lit(None).cast("double").alias("sim"))
    return pairs.unionByName(own).unionByName(other)


def per_sequence(rows: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """``kernel`` applied to each sequence; a sequence is one unit because matching depends on the frame before.

    It streams through its task: kernels of ``BY_FRAME`` hold one frame of it, the others its ids and pairs as columns.
    """
    names = ["seq", *[x.strip().split()[0] for x in schema.split(",")]]
    kinds = [KINDS[x.strip().split()[1]] for x in f"seq long, {schema}".split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq, frames in groupby(_frames(batches), key=lambda f: f[0]):
            pieces = (p for _, p in frames)
            found = kernel(Passing(pieces) if kernel in BY_FRAME else Sequence.of([p for of in pieces for p in of]))
            found = iter([found] if isinstance(found, dict) else found)
            while part := list(islice(found, ROWS)):
                columns = zip(*[[r[n] for n in names[1:]] if isinstance(r, dict) else r for r in part], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([[seq] * len(part), *columns], kinds, strict=True)], names=names)

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given a number, small sequences aren't put into one task
    own = rows.select("seq", "frame", "gid", "tid", "sim")
    return own.repartition(tasks, "seq").sortWithinPartitions("seq", "frame").mapInArrow(run, f"seq long, {schema}")


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple]]]:
    """seq and the pieces of each frame (see ``Sequence.of``) of batches sorted by both; a frame may go on in the next batch."""
    now, held = None, []
    for b in batches:
        seq, frame = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
        has = [b.column(k).is_valid().to_numpy(zero_copy_only=False) for k in (2, 3)]
        ids = [b.column(k).fill_null(0).to_numpy(zero_copy_only=False) for k in (2, 3)]
        sim = b.column(4).to_numpy(zero_copy_only=False).astype(float)
        new = np.flatnonzero(np.array([x != y for x, y in zip(seq[1:], seq[:-1], strict=True)], bool) | (frame[1:] != frame[:-1])) + 1
        for i, j in zip([0, *new.tolist()], [*new.tolist(), len(frame)], strict=True):
            if i < j:
                key = seq[i], int(frame[i])
                if held and now != key:
                    yield now[0], held
                    held = []
                now, part = key, slice(i, j)
                known = [h[part].copy() for h in has]
                held.append((frame[part].astype(np.int64), *known, *[x[part][h] for x, h in zip(ids, known, strict=True)], sim[part].copy()))
    if held:
        yield now[0], held


def with_total(df: DataFrame, counts: list[str]) -> DataFrame:
    """``df`` and a row of sums whose seq is -1."""
    total = df.agg(*[F.sum(c).cast(df.schema[c].dataType).alias(c) for c in counts]).select(F.lit(-1).cast("long").alias("seq"), *counts)
    return df.select("seq", *counts).unionByName(total)


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def clear_scores(df: DataFrame) -> DataFrame:
    gt = F.col("tp") + F.col("fn")
    return df.withColumns({
        "mota": F.round(_ratio(F.col("tp") - F.col("fp") - F.col("idsw"), gt), 6),
        "motp": F.round(_ratio(F.col("sim_sum"), F.col("tp")), 6),
        "moda": F.round(_ratio(F.col("tp") - F.col("fp"), gt), 6),
        "recall": F.round(_ratio(F.col("tp"), gt), 6),
        "precision": F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6),
        "f1": F.round(_ratio(F.col("tp"), F.col("tp") + 0.5 * F.col("fn") + 0.5 * F.col("fp")), 6),
        "smota": F.round(_ratio(F.col("sim_sum") - F.col("fp") - F.col("idsw"), gt), 6),
    })
