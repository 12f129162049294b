"""Average precision and recall of boxes over ten overlaps, areas and numbers of detections, as evaluators of detectors report them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..trackers.kernels import overlap

#: Overlaps at which a detection is right. Fixed values.
OVERLAPS = tuple(round(0.5 + 0.05 * k, 2) for k in range(10))
#: Areas, in pixels, from the first to below the second. Fixed values.
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
#: Recalls at which precision is read. Fixed values.
RECALLS = 101
#: Frames of a sequence that a Python call takes at once.
SPAN = 256


def matches(gt: np.ndarray, det: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """For detections (best score first): right and ignored, each (overlaps, detections).

    Each detection takes the free ground truth of largest overlap, one of the asked area before any other; one that takes a
    ground truth of another area is ignored, as is one of another area that takes none.
    """
    size = lambda b: b[:, 2] * b[:, 3]
    other, sim = ~((size(gt) >= low) & (size(gt) < high)), overlap(det, gt)
    odd = ~((size(det) >= low) & (size(det) < high))
    right, ignored = np.zeros((len(OVERLAPS), len(det)), bool), np.zeros((len(OVERLAPS), len(det)), bool)
    for k, least in enumerate(OVERLAPS):
        free = np.ones(len(gt), bool)
        for d in range(len(det)):
            best = -1
            for group in (~other, other):
                able = np.flatnonzero(free & group & (sim[d] >= least - 1e-10)) if len(gt) else []
                if len(able):
                    best = int(able[np.argmax(np.round(sim[d, able], 12))])
                    break
            if best >= 0:
                free[best] = False
                right[k, d], ignored[k, d] = not other[best], other[best]
            else:
                ignored[k, d] = odd[d]
    return right, ignored


def box_precision(gt: DataFrame, det: DataFrame, most: int = 100) -> DataFrame:
    """cls, area, threshold, ap, recall of gt (seq, frame, cls, box) and det (the same with score).

    Detections meet the ground truth of their frame and class; of a frame and class the ``most`` best scored count, by score,
    then x, then y. Results of frames are summed by score before the running sums, so no window holds all detections.
    Precision is read at ``RECALLS`` recalls, as the best at that recall or beyond. Classes or areas without ground truth
    are left out.
    """
    span = F.floor(F.col("frame") / SPAN).alias("span")
    box = ["x", "y", "w", "h"]
    left = gt.select("seq", span, "frame", "cls", *[F.col(c).cast("double").alias(c) for c in box])
    right = det.select("seq", span, "frame", "cls", "score", *[F.col(c).cast("double").alias(c) for c in box])
    kind = gt.schema["cls"].dataType.simpleString()

    def one(a: pa.Table, b: pa.Table) -> pa.Table:
        g, d = a.to_pandas(), b.to_pandas()
        rows = []
        truth = {k: v[box].to_numpy(float) for k, v in g.groupby(["frame", "cls"])}
        own = {k: v.sort_values(["score", *box], ascending=[False, True, True, True, True])[:most] for k, v in d.groupby(["frame", "cls"])}
        for key in sorted(set(truth) | set(own)):
            t = truth.get(key, np.zeros((0, 4)))
            for area, (low, high) in AREAS.items():
                n = int(((t[:, 2] * t[:, 3] >= low) & (t[:, 2] * t[:, 3] < high)).sum())
                if n:
                    rows.append((key[1], area, -1.0, None, 0, 0, n))
                if key in own:
                    v = own[key]
                    good, out = matches(t, v[box].to_numpy(float), low, high)
                    for k, least in enumerate(OVERLAPS):
                        rows += [(key[1], area, least, s, int(ok), 1, 0) for s, ok, no in zip(v["score"].tolist(), good[k], out[k], strict=True) if not no]
        columns = list(zip(*rows, strict=True)) or [[] for _ in range(7)]
        kinds = [b.schema.field("cls").type, pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["cls", "area", "threshold", "score", "good", "n", "truths"])

    by = ["seq", "span"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(one, f"cls {kind}, area string, threshold double, score double, good long, n long, truths long")
    summed = found.groupBy("cls", "area", "threshold", "score").agg(F.sum("good").alias("good"), F.sum("n").alias("n"), F.sum("truths").alias("truths"))
    truths = summed.filter("threshold < 0").select("cls", "area", "truths")
    s = summed.filter("threshold > 0").drop("truths").join(truths, ["cls", "area"])
    keys = ["cls", "area", "threshold"]
    down = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    good = F.sum("good").over(down)
    p = s.withColumns({"recall": good / F.col("truths"), "precision": good / F.sum("n").over(down)})
    up = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumns({"best": F.max("precision").over(up), "before": F.lag("recall", 1, -1.0).over(Window.partitionBy(*keys).orderBy(F.desc("score")))})
    # Recalls 0, 0.01, ... that are reached at this score and were not before.
    reached = lambda r: F.when(r < 0, 0).otherwise(F.floor(r * (RECALLS - 1) + 1e-9) + 1)
    p = p.withColumn("points", reached(F.col("recall")) - reached(F.col("before")))
    ap = p.groupBy(*keys).agg((F.sum(F.col("best") * F.col("points")) / RECALLS).alias("ap"), F.max("recall").alias("recall"))
    every = truths.select("cls", "area", F.explode(F.array(*[F.lit(x) for x in OVERLAPS])).alias("threshold"))
    return every.join(ap, keys, "left").select(*keys, F.coalesce("ap", F.lit(0.0)).alias("ap"), F.coalesce("recall", F.lit(0.0)).alias("recall"))
