"""Federated annotations: nested documents in which a video says for which classes its annotations can be trusted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import saved
from ..operators.pairs import frame_pairs

SCHEMA = (
    "videos ARRAY<STRUCT<id: BIGINT, name: STRING, neg_category_ids: ARRAY<BIGINT>, not_exhaustive_category_ids: ARRAY<BIGINT>>>, images ARRAY<STRUCT<id: BIGINT, video_id: BIGINT, frame_index: BIGINT>>, "
    "tracks ARRAY<STRUCT<id: BIGINT, category_id: BIGINT, video_id: BIGINT>>, annotations ARRAY<STRUCT<id: BIGINT, image_id: BIGINT, track_id: BIGINT, bbox: ARRAY<DOUBLE>>>"
)


def read_federated(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_federated(spark.read.text(path, wholetext=True))


def parse_federated(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boxes (seq, frame, id, cls, x, y, w, h) and videos (seq, name, negative, partial) of documents (value).

    Ids of images and tracks hold within a document. A track gives its annotations their class; annotations without a track or
    an image in their document are dropped, as are those whose box has not four numbers.
    """
    # Written once: the numbers that tell documents apart must be the same wherever they are read.
    doc = saved(documents.select(F.monotonically_increasing_id().alias("doc"), F.from_json("value", SCHEMA).alias("d")))
    none = F.array().cast("array<bigint>")
    videos = doc.select(F.explode("d.videos").alias("v")).select(F.col("v.id").alias("seq"), "v.name", F.coalesce("v.neg_category_ids", none).alias("negative"), F.coalesce("v.not_exhaustive_category_ids", none).alias("partial"))
    # Images, tracks and annotations are rows that meet by document and id: none of them carries its document along.
    part = lambda name: doc.select("doc", F.explode(F.array_distinct(f"d.{name}")).alias("r"))
    images = part("images").select("doc", F.col("r.id").alias("image_id"), F.col("r.video_id").alias("seq"), F.col("r.frame_index").alias("frame"))
    tracks = part("tracks").select("doc", F.col("r.id").alias("track_id"), F.col("r.category_id").alias("cls"))
    notes = doc.select("doc", F.explode("d.annotations").alias("a")).select("doc", "a.image_id", "a.track_id", "a.bbox").filter("size(bbox) = 4")
    found = notes.join(images, ["doc", "image_id"]).join(tracks, ["doc", "track_id"])
    boxes = found.select("seq", "frame", F.col("track_id").alias("id"), "cls", *[F.get("bbox", F.lit(k)).alias(c) for k, c in enumerate("xywh")])
    return boxes, videos


def judged(gt: DataFrame, det: DataFrame, videos: DataFrame, least: float = 0.5) -> DataFrame:
    """``det`` (seq, frame, id, cls, box) with verdict: right, wrong or ignored.

    A detection on a ground truth of its class is right. Any other is wrong only where the video says so: its class is annotated
    there or listed as absent, and not listed as annotated in part; else nobody knows, and it is ignored.
    """
    hit = frame_pairs(gt, det, ("seq", "frame", "cls"), least=least).withColumnRenamed("tid", "id").withColumn("right", F.lit(True))
    keys = ["seq", "frame", "id", "cls"]
    present = gt.groupBy("seq").agg(F.collect_set("cls").alias("present"))  # the classes of a video
    both = det.join(hit.select(*keys, "right").distinct(), keys, "left").join(videos.select("seq", "negative", "partial"), "seq", "left").join(present, "seq", "left")
    inside = lambda name: F.coalesce(F.array_contains(name, F.col("cls")), F.lit(False))
    verdict = F.when(F.col("right"), "right").when((inside("present") | inside("negative")) & ~inside("partial"), "wrong").otherwise("ignored")
    return both.withColumn("verdict", verdict).drop("right", "negative", "partial", "present")
