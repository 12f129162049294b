"""Trackers on the synthetic detections. Their results have no SQL form; tests check invariants."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from .. import views as V
from ..metrics import kernels as K
from ..metrics.frames import clear_scores, per_sequence, sides
from ..registry import query
from ..trackers.frames import labelled, merge_untracked, nms, track
from ..trackers.kernels import PUBLIC, TRACKERS
from .accuracy import CLEAR


def scored(spark, sf_dir):
    """The synthetic tracks without their ids, as raw detections."""
    t = V.tracks(spark, sf_dir)
    return t.select("seq", "frame", "x", "y", "w", "h", ((F.col("id") * 3 + F.col("frame")) % 7 / 10 + 0.3).alias("score"), (F.col("id") % 2).alias("cls"))


def shown(tracks):
    return tracks.select("seq", "frame", "id", *[F.round(c, 3).alias(c) for c in "xywh"], F.round("score", 2).alias("score"))


def _register(name: str, covers: str) -> None:
    def run(spark, sf_dir):
        return shown(track(scored(spark, sf_dir), name))

    run.__name__ = f"track_{name}"
    run.__doc__ = f"Tracks of the {name} parameters."
    query(covers)(run)


for _name, _covers in {
    "sort": "RET20", "bytetrack": "TRK1 TRK2", "bytetrack_plus": "TRK4", "ocsort": "TRK8 TRK12 JN12", "hybridsort": "TRK9 JN13", "botsort": "TRK10",
    "fasttracker": "RET19", "class_aware": "TRK7", "deepsort_motion": "RET22", "bytetrack_guarded": "TRK4", "bytetrack_ciou": "TRK5",
    "ocsort_by_class": "RET25", "hybridsort_by_class": "RET25",
}.items():
    assert _name in TRACKERS
    _register(_name, _covers)


def looking(spark, sf_dir):
    """The synthetic detections with a vector of looks: the whole one of the user's own row in ``embeddings``, a little turned from frame to frame.

    With fewer rows than users, users take them by turns; a box whose user has no row stays, with looks of zeros.
    """
    d = V.tracks(spark, sf_dir)
    e = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("who"), F.col("embedding").cast("array<double>").alias("e"))
    of = e.agg(F.max("who"), F.max(F.size("e"))).first()
    user = (F.floor(F.col("x") / 50) * 8 + F.col("seq")).cast("long")  # ids of tracks don't tell users from a thousand on, their places do
    d = d.select("seq", "frame", "x", "y", "w", "h", ((F.col("id") * 3 + F.col("frame")) % 7 / 10 + 0.3).alias("score"), (F.col("id") % 2).alias("cls"), F.pmod(user, F.lit((of[0] or 0) + 1)).alias("who"))
    looks = F.coalesce("e", F.array_repeat(F.lit(0.0), of[1] or 1))
    return d.join(e, "who", "left").withColumn("looks", F.transform(looks, lambda v, i: v + 0.02 * ((F.col("frame") + i) % 5))).drop("who", "e")


def _with_looks(name: str, covers: str) -> None:
    def run(spark, sf_dir):
        return shown(track(looking(spark, sf_dir), name))

    run.__name__ = f"track_{name}"
    run.__doc__ = f"Tracks of the {name} parameters over boxes with looks."
    query(covers)(run)


for _name, _covers in {"deepsort": "RET21", "hybridsort_reid": "RET26", "botsort_reid": "TRK10 RET26", "motdt": "RET23", "bytetrack_reid": "TRK3"}.items():
    assert _name in TRACKERS
    _with_looks(_name, _covers)


@query("RET24")
def track_bytetrack_public(spark, sf_dir):
    """Tracks that start only where a public detection (here the ground truth of every other user) stands for them."""
    public = V.ground_truth(spark, sf_dir).filter("id % 16 < 8")
    return shown(track(scored(spark, sf_dir), PUBLIC, public))


#: A region about all places of the first hundred users of a sequence: its direction is to the right, give or take 45 degrees.
REGION = ((-100.0, -100.0), (-100.0, 100.0), (4900.0, 5100.0), (4900.0, -5100.0))


@query("TRK6")
def track_fasttracker_in_region(spark, sf_dir):
    """Tracks kept to a region and to its direction; boxes of one class drift along it, those of the other against it."""
    drifting = scored(spark, sf_dir).withColumn("x", F.col("x") + (F.col("cls") * 2 - 1) * F.col("frame") * 0.5)
    return shown(track(drifting, replace(TRACKERS["fasttracker"], regions=(REGION,))))


@query("TRK2 FLT20")
def track_with_untracked(spark, sf_dir):
    d = scored(spark, sf_dir)
    out = merge_untracked(track(d, "bytetrack"), d, 0.5)
    return out.select("seq", "frame", "id", F.round("x", 3).alias("x"), F.round("score", 2).alias("score"))


@query("TRK1 AGG36 SRC16")
def tracker_accuracy(spark, sf_dir):
    """Accuracy of the two-stage tracker on ground truth boxes as detections."""
    g = V.ground_truth(spark, sf_dir)
    d = g.select("seq", "frame", "x", "y", "w", "h", F.lit(1.0).alias("score"), F.lit(0).cast("long").alias("cls"))
    per = per_sequence(sides(g, track(d, "bytetrack")), K.clear, CLEAR)
    return clear_scores(per).select("seq", "tp", "fn", "fp", "idsw", "mota")


@query("RET11")
def non_maximum_suppression(spark, sf_dir):
    d = V.detections(spark, sf_dir).withColumns({"x": (F.col("id") % 7) * 15.0, "y": (F.col("id") % 3) * 10.0})
    return nms(d.select("seq", "frame", "cls", "id", "score", "x", "y", "w", "h"), 0.3).select("seq", "frame", "cls", "id", "score")


@query("RET11")
def suppression_of_labels(spark, sf_dir):
    """Boxes with a score for each of three classes: all labels that score enough, suppressed across classes, the best five of a frame."""
    d = V.detections(spark, sf_dir).withColumns({"x": (F.col("id") % 7) * 15.0, "y": (F.col("id") % 3) * 10.0})
    scores = F.array(*[((F.col("cell") * (k + 3) + F.col("id")) % 10) / 10 for k in range(3)])
    boxes = d.select("seq", "frame", "id", "x", "y", "w", "h", scores.alias("scores"))
    return nms(labelled(boxes, "scores", 0.35, True), 0.3, agnostic=True, most=5).select("seq", "frame", "id", "cls", "score")
