"""Detections, ground truth and tracks derived from the ``events`` table, with the SQL of the same views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts):
    """Microseconds since the epoch of a time without zone, whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ms (epoch milliseconds) and frame (hour, from 1)."""
    e = table(spark, sf_dir, "events").withColumn("ms", F.expr("cast(0 as bigint)") + (micros(F.col("ts")) / 1000).cast("long"))
    return e.withColumn("frame", F.floor(F.col("ms") / 3600000) - 473351)


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, frame, id, n, x, y, w, h: a box per user and hour."""
    e = events(spark, sf_dir)
    g = e.groupBy((F.col("user_id") % 8).alias("seq"), "frame", F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("seq", "frame", "id", "n", (F.floor(F.col("id") / 8) * 50).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(40.0).alias("w"), F.lit(30.0).alias("h"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, frame, id, x, y, w, h: the ground truth with drop-outs, identity changes and false positives."""
    g = ground_truth(spark, sf_dir)
    seen = g.filter((F.col("id") + F.col("frame")) % 11 != 0)
    seen = seen.select("seq", "frame", (F.col("id") + 1000 * F.floor(F.col("frame") / 240)).alias("id"), (F.col("x") + F.col("n") % 3).alias("x"), "y", "w", "h")
    false = g.filter((F.col("id") * 7 + F.col("frame")) % 13 == 0).select("seq", "frame", (F.col("id") + 100000).alias("id"), "x", F.lit(500.0).alias("y"), "w", "h")
    return seen.unionByName(false)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, frame, id, cls, score, cell, x, y, w, h: scored boxes of five classes on a 32 by 32 grid."""
    g = ground_truth(spark, sf_dir)
    return g.select("seq", "frame", "id", (F.col("id") % 5).alias("cls"), ((F.col("n") * 3 + F.col("id") + F.col("frame")) % 10 / 10).alias("score"),
                    ((F.col("id") * 7 + F.col("frame") * 13 + F.col("n")) % 1024).alias("cell"), "x", "y", "w", "h")


def every_frame(boxes: DataFrame) -> DataFrame:
    """seq, frame: for each sequence the frames from 1 to the last one of the table."""
    last = boxes.agg(F.max("frame")).scalar()
    return boxes.select("seq").distinct().withColumn("last", last).select("seq", F.explode(F.sequence(F.lit(1).cast("long"), F.col("last"))).alias("frame"))


#: The same views for the oracles.
EV = "ev AS (SELECT *, epoch_us(ts) // 1000 AS ms, CAST(floor(epoch(ts) / 3600) AS BIGINT) - 473351 AS frame FROM events)"
GT = EV + """,
gt AS (SELECT user_id % 8 AS seq, frame, user_id AS id, count(*) AS n, CAST((user_id // 8) * 50 AS DOUBLE) AS x, 0.0::DOUBLE AS y, 40.0::DOUBLE AS w, 30.0::DOUBLE AS h
  FROM ev GROUP BY ALL)"""
TRK = GT + """,
trk AS (SELECT seq, frame, id + 1000 * (frame // 240) AS id, x + n % 3 AS x, y, w, h FROM gt WHERE (id + frame) % 11 <> 0
  UNION ALL SELECT seq, frame, id + 100000 AS id, x, 500.0 AS y, w, h FROM gt WHERE (id * 7 + frame) % 13 = 0)"""
DET = GT + """,
det AS (SELECT seq, frame, id, id % 5 AS cls, ((n * 3 + id + frame) % 10) / 10 AS score, (id * 7 + frame * 13 + n) % 1024 AS cell, x, y, w, h FROM gt)"""
PAIRS = TRK + """,
pairs AS (SELECT g.seq, g.frame, g.id AS gid, t.id AS tid, g.w * g.h AS ga, t.w * t.h AS ta,
    greatest(0, least(g.x + g.w, t.x + t.w) - greatest(g.x, t.x)) * greatest(0, least(g.y + g.h, t.y + t.h) - greatest(g.y, t.y)) AS inter
  FROM gt g JOIN trk t ON g.seq = t.seq AND g.frame = t.frame),
iou AS (SELECT *, inter / (ga + ta - inter) AS iou FROM pairs),
hit AS (SELECT * FROM iou WHERE iou >= 0.5)"""
