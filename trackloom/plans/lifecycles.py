"""Rules that fold over a sequence: the entity registry, rare appearances, sampling and image quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..operators import microtracks as M
from ..operators import monitors as Q
from ..registry import query
from ..streaming import entities as E

ENTITIES = E.Options(gap=6, keep=10, confidence=0.45, span=20.0, place=0.6, listed_for=200)


def sightings(spark, sf_dir):
    """seq, ms, id, cls, conf, box: every third user moves, and classes are mistaken at times."""
    d = V.detections(spark, sf_dir)
    return d.select("seq", F.col("frame").alias("ms"), "id", ((F.col("id") + F.floor(F.col("frame") / 60)) % 3).alias("cls"), F.col("score").alias("conf"), (F.col("x") + F.when(F.col("id") % 3 == 0, F.col("frame") * 0.5).otherwise(0.0)).alias("x"), "y", "w", "h")


@query("STR1 STR2 STR3 JN29")
def entity_registry(spark, sf_dir):
    """What becomes of each entity: created, changed, removed, reactivated, purged, listed by confidence or place, unlisted by moving."""
    return E.registry(sightings(spark, sf_dir), "seq", ENTITIES)


HAZARDS = M.Options(near=12.0, latency=3, ratio=0.6, hold=6, ignored_spread=2.0, ignored_near=10.0, ignored_for=120)


def hazards(spark, sf_dir):
    d = V.detections(spark, sf_dir)
    return d.select("seq", "frame", F.col("score").alias("conf"), (F.col("cell") % 3 > 0).alias("vote"), (F.col("id") % 40 * 9 + F.col("cell") % 4).cast("double").alias("x"), (F.col("id") * 7 % 20 * 11).cast("double").alias("y"), F.lit(8.0).alias("w"), F.lit(6.0).alias("h"))


@query("STR35")
def rare_appearances(spark, sf_dir):
    """Alerts of micro-tracks, without ids."""
    found = M.rare_appearances(hazards(spark, sf_dir), "seq", HAZARDS)
    return found.select("seq", "frame", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "confidence", "n", "votes")


SAMPLER = Q.Sampler(period=3_600_000, longest=6 * 3_600_000, latency=3, valid=2, motion=30.0)


@query("STR31")
def sampled_states(spark, sf_dir):
    """Samples of each user's state, which motion or a long wait calls for, at a rate that follows how far the last ones agree."""
    e = V.events(spark, sf_dir).select("user_id", "ms", "event_id", F.col("event_type").alias("state"), F.col("value").alias("motion"))
    return Q.sampled(e, "user_id", "event_id", SAMPLER)


QUALITY = Q.Quality(first=5 * 86_400_000, period=3_600_000, factor=4, shortest=600_000, consecutive=2, transition=86_400_000, quantile=0.3, bias=2.0)


@query("STR49")
def image_quality(spark, sf_dir):
    """Flags of a score against a threshold from the first five days: nothing, short or lasting degradation."""
    e = V.events(spark, sf_dir).select((F.col("user_id") % 8).alias("camera"), "ms", "event_id", F.col("value").alias("score"))
    return Q.quality(e, "camera", "event_id", QUALITY)
