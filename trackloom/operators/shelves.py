"""Shelves: how full polygons are, and when to say so."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .polygons import polygon_area, polygons_on_boxes


def occupancy(shelves: DataFrame, empty: DataFrame, hiding: DataFrame, frames: DataFrame, cell: float, hidden: float) -> DataFrame:
    """seq, frame, polygon, occupancy, occluded: of each shelf in each frame (seq, frame) of its sequence.

    ``empty`` are boxes of empty places, ``hiding`` boxes of what stands in front. A shelf's occupancy is one less the share of
    its area that empty boxes cover, 0 at least; it is occluded if more than ``hidden`` of its area is.
    """
    own = shelves.select("seq", "polygon", "vertices", polygon_area(F.col("vertices")).alias("area")).filter("area > 0")
    covered = lambda boxes, name: polygons_on_boxes(own, boxes, ["seq"], cell, 0.0, "polygon").groupBy("seq", "frame", "polygon").agg(F.sum("share").alias(name))
    key = ["seq", "frame", "polygon"]
    each = own.select("seq", "polygon").join(frames, "seq").join(covered(empty, "bare"), key, "left").join(covered(hiding, "hides"), key, "left")
    return each.select(*key, F.greatest(F.lit(0.0), 1 - F.coalesce("bare", F.lit(0.0))).alias("occupancy"), (F.coalesce("hides", F.lit(0.0)) > hidden).alias("occluded"))


_BY = ("seq", "polygon")


def history(shelf: DataFrame, period: int) -> DataFrame:
    """seq, polygon, period, occupancy, n: mean of each period's samples that nothing hid; a period without any keeps the latest mean before it."""
    p = shelf.groupBy(*_BY, F.floor(F.col("frame") / period).alias("period")).agg(F.avg(F.when(~F.col("occluded"), F.col("occupancy"))).alias("mean"), F.count_if(~F.col("occluded")).alias("n"))
    so_far = Window.partitionBy(*_BY).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return p.select(*_BY, "period", F.last("mean", ignorenulls=True).over(so_far).alias("occupancy"), "n")


def low(shelf: DataFrame, below: float, filled: float) -> DataFrame:
    """seq, polygon, frame: a shelf falls below, once until it has been filled again while nothing hid it."""
    state = F.when(F.col("occupancy") < below, "low").when((F.col("occupancy") > filled) & ~F.col("occluded"), "full")
    s = shelf.withColumn("state", state).filter("state is not null")
    was = F.lag("state", 1, "full").over(Window.partitionBy(*_BY).orderBy("frame"))
    return s.withColumn("was", was).filter("state = 'low' and was = 'full'").select(*_BY, "frame")


def periodic(shelf: DataFrame, below: float, period: int) -> DataFrame:
    """seq, polygon, frame: the first frame of each period in which a shelf is below and not hidden."""
    return shelf.filter((F.col("occupancy") < below) & ~F.col("occluded")).groupBy(*_BY, F.floor(F.col("frame") / period).alias("p")).agg(F.min("frame").alias("frame")).drop("p")


def dropped(shelf: DataFrame, within: int, by: float) -> DataFrame:
    """seq, polygon, frame, fall: a shelf is emptier by so much than at its fullest of the last frames, and was not a frame of its own before. Hidden frames don't count."""
    w = Window.partitionBy(*_BY).orderBy("frame")
    s = shelf.filter("not occluded").withColumn("fall", F.max("occupancy").over(w.rangeBetween(-within, 0)) - F.col("occupancy"))
    return s.withColumn("was", F.lag("fall", 1, 0.0).over(w)).filter((F.col("fall") >= by - 1e-9) & (F.col("was") < by - 1e-9)).select(*_BY, "frame", "fall")
