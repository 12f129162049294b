"""Joins of boxes that share a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import box, iou


#: Side of the cells in which boxes meet that must overlap.
CELL = 128.0


def _dealt(boxes: DataFrame, name: str) -> DataFrame:
    """``boxes`` once for each cell of a square grid that they cover."""
    cells = lambda at, size: F.explode(F.sequence(F.floor(F.col(at) / CELL), F.floor((F.col(at) + F.col(size)) / CELL)))
    return boxes.filter("w > 0 and h > 0").select("*", cells("x", "w").alias("__cx")).select("*", cells("y", "h").alias("__cy")).alias(name)


def frame_pairs(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("seq", "frame"), similarity=iou, least: float | None = None, touching: bool = False) -> DataFrame:
    """keys, gid, tid, sim for boxes (id, x, y, w, h) of one frame. An equi-join on the frame; pairs are nested within frames only.

    ``touching``, and IoU of a ``least`` above zero: only pairs whose similarity is above zero, which must be those that
    overlap. They meet in the cells of a grid, each pair in the one where its overlap begins, so that the work goes with the
    boxes that are near each other, not with the square of a frame's. Boxes far larger than a cell cost a row for each cell.
    """
    near = touching or (similarity is iou and least is not None and least > 0)
    a, b = (_dealt(left, "a"), _dealt(right, "b")) if near else (left.alias("a"), right.alias("b"))
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*keys, *(("__cx", "__cy") if near else ()))]
    if near:
        on += [F.floor(F.greatest(f"a.{c}", f"b.{c}") / CELL) == F.col(f"a.__c{c}") for c in "xy"]
    sim = similarity(box(alias="a"), box(alias="b"))
    out = a.join(b, on).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.id").alias("gid"), F.col("b.id").alias("tid"), sim.alias("sim"))
    out = out.filter("sim > 0") if near else out
    return out if least is None else out.filter(F.col("sim") >= least)


def frame_spine(frames: DataFrame, counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``counts`` with a row, zero if need be, for every row of ``frames``."""
    return frames.join(counts, keys, "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))
