"""Average precision of whole tracks: overlaps of tracks summed over frames, greedy matching by score, precision at 101 recalls."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import area, box, intersection
from ..operators.pairs import frame_pairs

#: Overlap thresholds in hundredths, and ranges of mean box area and of length in frames.
THRESHOLDS = [50, 55, 60, 65, 70, 75, 80, 85, 90, 95]
RANGES = {"all": ("area", 0.0, 1e10), "area_s": ("area", 0.0, 32.0**2), "area_m": ("area", 32.0**2, 96.0**2), "area_l": ("area", 96.0**2, 1e10), "time_s": ("n", 0.0, 3.0), "time_m": ("n", 3.0, 10.0), "time_l": ("n", 10.0, 1e5)}
_EDGE = 2.220446049250313e-16


def whole_tracks(boxes: DataFrame, *more) -> DataFrame:
    """seq, cls, id, total (area over all frames), n (frames), area (mean)."""
    size = area(box())
    return boxes.groupBy("seq", "cls", "id").agg(F.sum(size).alias("total"), F.count(F.lit(1)).alias("n"), F.avg(size).alias("area"), *more)


def overlaps(gt: DataFrame, trk: DataFrame, least: float) -> DataFrame:
    """seq, cls, gid, tid, sim: shared area over joint area, each summed over all frames of either track."""
    both = frame_pairs(gt, trk, ("seq", "cls", "frame"), intersection, touching=True)
    shared = both.groupBy("seq", "cls", "gid", "tid").agg(F.sum("sim").alias("shared"))
    side = lambda boxes, name: whole_tracks(boxes).select("seq", "cls", F.col("id").alias(f"{name}id"), F.col("total").alias(f"{name}total"))
    sim = F.col("shared") / (F.col("gtotal") + F.col("ttotal") - F.col("shared"))
    out = shared.join(side(gt, "g"), ["seq", "cls", "gid"]).join(side(trk, "t"), ["seq", "cls", "tid"])
    return out.select("seq", "cls", "gid", "tid", sim.alias("sim")).filter(F.col("sim") >= least)


def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    """Matches of one sequence and class. Tracks choose by score (then id): the best free counted partner, else the best ignored one; ties go to the larger id."""
    out = []
    by_track = [(tid, g.sort_values(["sim", "gid"], ascending=False)[["gid", "sim", "area", "n"]].to_dict("records")) for (_, tid), g in pdf.assign(neg=-pdf["score"]).groupby(["neg", "tid"], sort=True)]
    for name, (field, low, high) in RANGES.items():
        for limit in THRESHOLDS:
            taken = set()
            for tid, options in by_track:
                free = [o for o in options if o["sim"] >= limit / 100 - _EDGE and o["gid"] not in taken]
                counted = [o for o in free if low - _EDGE <= o[field] <= high + _EDGE]
                if free:
                    best = (counted or free)[0]
                    taken.add(best["gid"])
                    out.append((pdf["seq"].iloc[0], pdf["cls"].iloc[0], name, limit, tid, bool(counted)))
    return pd.DataFrame(out, columns=["seq", "cls", "span", "threshold", "id", "counted"])


def track_precision(gt: DataFrame, trk: DataFrame) -> DataFrame:
    """cls, span, threshold, ap, recall. gt: seq, cls, frame, id, box; trk: with score, too. Classes and spans without ground truth give no row."""
    names = F.explode(F.array(*[F.lit(k) for k in RANGES]))
    inside = F.lit(False)
    for name, (field, low, high) in RANGES.items():
        inside = F.when(F.col("span") == name, F.col(field).between(low - _EDGE, high + _EDGE)).otherwise(inside)
    whole = whole_tracks(gt)
    n = whole.withColumn("span", names).filter(inside).groupBy("cls", "span").agg(F.count(F.lit(1)).alias("truth"))
    scored = whole_tracks(trk, F.avg("score").alias("score"))
    pairs = overlaps(gt, trk, THRESHOLDS[0] / 100 - _EDGE)
    pairs = pairs.join(whole.select("seq", "cls", F.col("id").alias("gid"), "area", "n"), ["seq", "cls", "gid"]).join(scored.select("seq", "cls", F.col("id").alias("tid"), "score"), ["seq", "cls", "tid"])
    matched = pairs.groupBy("seq", "cls").applyInPandas(greedy, "seq long, cls long, span string, threshold int, id long, counted boolean")
    grid = scored.withColumn("span", names).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])))
    # A match with an ignored partner and an unmatched track out of range count neither way.
    judged = grid.join(matched, ["seq", "cls", "span", "threshold", "id"], "left").withColumn("hit", F.coalesce("counted", F.lit(False)))
    judged = judged.filter(F.col("hit") | (F.col("counted").isNull() & inside))
    keys = ["cls", "span", "threshold"]
    so_far = Window.partitionBy(*keys).orderBy(F.desc("score"), "seq", "id").rowsBetween(Window.unboundedPreceding, 0)
    run = judged.withColumns({"tp": F.sum(F.col("hit").cast("long")).over(so_far), "all": F.count(F.lit(1)).over(so_far)})
    level = run.filter("tp > 0").groupBy(*keys, "tp").agg(F.max(F.col("tp") / F.col("all")).alias("precision"))
    level = level.withColumn("best", F.max("precision").over(Window.partitionBy(*keys).orderBy(F.desc("tp")).rowsBetween(Window.unboundedPreceding, 0)))
    # How many of the recalls 0, 0.01, ..., 1 are first reached at this number of hits.
    reached = lambda k: F.floor(100 * k / F.col("truth"))
    level = level.join(F.broadcast(n), ["cls", "span"]).withColumn("of", reached(F.col("tp")) - reached(F.col("tp") - 1) + (F.col("tp") == 1).cast("long"))
    found = level.groupBy(*keys).agg((F.sum(F.col("best") * F.col("of")) / 101).alias("ap"), F.max(F.col("tp") / F.col("truth")).alias("recall"))
    every = n.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])))
    return every.join(found, keys, "left").select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("ap", "recall")])
