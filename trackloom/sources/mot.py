"""Tracking text formats: ragged box rows, sequence metadata, per-frame tables, XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.filters import by_policy

BOX = ["frame", "id", "x", "y", "w", "h", "conf", "cls", "visibility"]


def parse_lines(lines: DataFrame, value: str = "value", conf_default: float = 1.0, force_conf: float | None = None) -> DataFrame:
    """Box rows from text: fields split at commas or white space, rows of fewer than six dropped, negative or missing confidence
    replaced, missing class and visibility null. Other columns of ``lines`` are kept."""
    parts = F.split(F.trim(F.col(value)), "[,\\s]+")
    number = lambda i, kind: F.expr(f"try_cast(element_at(__p, {i + 1}) AS {kind})")
    at = lambda i, kind: F.when(F.size("__p") > i, number(i, kind))
    out = lines.withColumn("__p", parts).filter(F.size("__p") >= 6)
    conf = F.lit(force_conf) if force_conf is not None else F.when(at(6, "double") >= 0, at(6, "double")).otherwise(F.lit(conf_default))
    out = out.withColumns({
        "frame": number(0, "double").cast("int"), "id": number(1, "double").cast("int"), "x": number(2, "double"), "y": number(3, "double"), "w": number(4, "double"), "h": number(5, "double"),
        "conf": conf.cast("double"), "cls": at(7, "double").cast("int"), "visibility": F.when(F.size("__p") > 8, F.element_at("__p", 9))})
    return out.drop("__p", value)


def read_boxes(spark: SparkSession, path: str, conf_default: float = 1.0) -> DataFrame:
    """seq (from the path) and box columns of ``<seq>/gt/gt.txt`` or ``<seq>/det/det.txt`` files under a glob."""
    lines = spark.read.text(path).withColumn("seq", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/(?:gt|det)/[^/]+$", 1))
    return parse_lines(lines, conf_default=conf_default)


def filter_rows(boxes: DataFrame, keep: set[int] | None = None, drop: set[int] = frozenset(), keep_frames: DataFrame | None = None, rewrite: int | None = None) -> DataFrame:
    """Class policy (rows without a class pass), frame subset by semi join, class rewriting."""
    out = boxes.filter(by_policy(F.col("cls"), keep, set(drop)))
    if keep_frames is not None:
        out = out.join(keep_frames.select("frame").distinct(), "frame", "left_semi")
    return out if rewrite is None else out.withColumn("cls", F.lit(rewrite))


def filter_file(spark: SparkSession, source: str, target: str, keep: set[int] | None = None, drop: set[int] = frozenset()) -> int:
    """Copies the lines of a box file whose class passes the policy, as they are, and returns their number."""
    lines = spark.read.text(source)
    kept = filter_rows(parse_lines(lines.withColumn("line", F.col("value"))), keep, drop).select("line")
    kept.write.mode("overwrite").text(target)
    return spark.read.text(target).count()


def parse_pixels(lines: DataFrame, value: str = "value") -> DataFrame:
    """Box rows of texts whose pixels count from 1: x and y are shifted by one; a confidence may be any number."""
    number = lambda i, kind: F.expr(f"try_cast(element_at(__p, {i}) AS {kind})")
    p = lines.withColumn("__p", F.split(F.trim(F.col(value)), "\\s*,\\s*|\\s+")).filter(F.size("__p") >= 6)
    at = lambda i, kind, default: F.when(F.size("__p") >= i, number(i, kind)).otherwise(F.lit(default).cast(kind))
    return p.withColumns({"frame": number(1, "int"), "id": number(2, "int"), "x": number(3, "double") - 1, "y": number(4, "double") - 1, "w": number(5, "double"), "h": number(6, "double"), "conf": at(7, "double", 1.0), "cls": at(8, "int", -1), "visibility": at(9, "double", -1.0)}).drop("__p", value)


def parse_vatic(lines: DataFrame, value: str = "value") -> DataFrame:
    """Annotation rows: id, corners, frame, three flags, a quoted label and quoted attributes, of which a sorted array is kept."""
    p = lines.withColumn("__p", F.split(F.trim(F.col(value)), " "))
    number = lambda i: F.expr(f"try_cast(element_at(__p, {i}) AS double)")
    quoted = F.transform(F.slice("__p", 11, 1 << 20), lambda x: F.trim(x, F.lit('"')))
    flag = lambda i: F.element_at("__p", i) == "1"
    out = p.withColumns({"frame": number(6).cast("int"), "id": number(1).cast("int"), "x": number(2), "y": number(3), "w": number(4) - number(2), "h": number(5) - number(3), "lost": flag(7), "occluded": flag(8), "generated": flag(9), "label": F.trim(F.element_at("__p", 10), F.lit('"')), "attributes": F.array_sort(quoted)})
    return out.drop("__p", value)


def parse_corner_text(lines: DataFrame, classes: dict[str, int], value: str = "value") -> DataFrame:
    """Box rows of "frame id type truncated occluded alpha left top right bottom ..." lines; types without a class are dropped, frames count from 0."""
    p = lines.withColumn("__p", F.split(F.trim(F.col(value)), "\\s+")).filter(F.size("__p") >= 10)
    number = lambda i, kind: F.expr(f"try_cast(element_at(__p, {i}) AS {kind})")
    mapping = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    out = p.withColumns({"frame": number(1, "int") + 1, "id": number(2, "int"), "cls": mapping[F.lower(F.element_at("__p", 3))], "truncated": number(4, "double"), "occluded": number(5, "double"), "x": number(7, "double"), "y": number(8, "double"), "w": number(9, "double") - number(7, "double"), "h": number(10, "double") - number(8, "double"), "conf": F.when(F.size("__p") >= 18, number(18, "double")).otherwise(1.0)})
    return out.filter("cls is not null").drop("__p", value)


def camera_names(paths: DataFrame) -> DataFrame:
    """scenario, camera and the flat sequence name of ``<split>/<scenario>/<camera>/gt/gt.txt`` paths; other paths give nothing."""
    part = lambda i: F.regexp_extract("path", "([^/]+)/([^/]+)/([^/]+)/gt/gt\\.txt$", i)
    found = paths.select(part(1).alias("split"), part(2).alias("scenario"), part(3).alias("camera")).filter("camera <> ''")
    return found.withColumn("seq", F.concat_ws("_", "scenario", "camera"))


def sequence_length(extracted: Column, prior: Column, last: Column) -> Column:
    """The most of the extracted frames, the length stated before, and the last frame of the ground truth; missing ones don't count."""
    return F.greatest(F.coalesce(extracted, F.lit(0)), F.coalesce(prior, F.lit(0)), F.coalesce(last, F.lit(0)))


def to_corners(boxes: DataFrame, keep: set[int] | None = None, drop: set[int] = frozenset()) -> DataFrame:
    """Detections as corners; here a missing class counts as 0 and takes part in the policy."""
    c = F.coalesce(F.col("cls"), F.lit(0))
    out = boxes.withColumn("cls", c).filter(by_policy(F.col("cls"), keep, set(drop)))
    return out.select("frame", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"), F.col("conf").alias("score"), "cls")


def stride(native: Column, target: Column) -> Column:
    """max(1, native / target rounded, halves to even); an unknown native rate counts as 30."""
    rate = F.when(native > 0, native).otherwise(30.0)
    return F.when(target > 0, F.greatest(F.lit(1), F.bround(rate / target))).otherwise(1).cast("int")


def schedule(explicit: Column, native: Column, target: Column) -> Column:
    """Frame stride: the explicit one, else by the target rate, else every frame."""
    return F.coalesce(F.when(explicit > 0, explicit), F.when(target.isNotNull(), stride(native, target)), F.lit(1)).cast("int")


def kept_frames(meta: DataFrame, length: str, step: str) -> DataFrame:
    """frame 1, 1 + step, ... up to the length, per row of ``meta``."""
    return meta.withColumn("frame", F.explode(F.sequence(F.lit(1), F.col(length), F.col(step))))


def read_seqinfo(spark: SparkSession, path: str) -> DataFrame:
    """seq and a map of the key = value lines of seqinfo.ini files; the case of keys is kept."""
    return parse_seqinfo(spark.read.text(path, wholetext=True).withColumn("seq", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1)))


def parse_seqinfo(text: DataFrame) -> DataFrame:
    """seq and a map of the key = value lines of whole INI texts (columns seq, value)."""
    pairs = F.filter(F.split("value", "\\r?\\n"), lambda line: F.regexp_like(line, F.lit("^[^#;\\[][^=]*=")))
    entry = F.transform(pairs, lambda line: F.struct(F.trim(F.split_part(line, F.lit("="), F.lit(1))).alias("k"), F.trim(F.regexp_replace(line, "^[^=]*=", "")).alias("v")))
    return text.select("seq", F.map_from_entries(entry).alias("info"))


def write_seqinfo(meta: DataFrame) -> DataFrame:
    """The INI text of each row (name, frame_rate, seq_length, im_width, im_height, im_ext, im_dir)."""
    line = lambda key, c: F.concat(F.lit(f"{key}="), F.col(c).cast("string"))
    body = F.concat_ws("\n", F.lit("[Sequence]"), line("name", "name"), line("imDir", "im_dir"), line("frameRate", "frame_rate"), line("seqLength", "seq_length"), line("imWidth", "im_width"), line("imHeight", "im_height"), line("imExt", "im_ext"))
    return meta.select(F.col("name").alias("seq"), F.concat(body, F.lit("\n")).alias("value"))


def discover(spark: SparkSession, root: str, wanted: DataFrame | None = None) -> DataFrame:
    """Sequences under ``root`` that have metadata or ground truth, hidden folders left out."""
    return discovered(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path"), wanted)


def discovered(files: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The sequences of which ``files`` (column path) has metadata or ground truth."""
    name = F.regexp_extract("path", "([^/]+)/(?:seqinfo\\.ini|gt/gt\\.txt)$", 1)
    out = files.select(name.alias("seq")).filter((F.col("seq") != "") & ~F.col("seq").startswith(".") & (F.col("seq") != "__MACOSX")).distinct()
    return out if wanted is None else out.join(wanted, "seq", "left_semi")


def frame_number(path: Column) -> Column:
    """The digits of a file's stem as a number."""
    stem = F.regexp_extract(path, "([^/]+?)(?:\\.[^./]*)?$", 1)
    return F.regexp_replace(stem, "\\D", "").try_cast("bigint")


def format_tracks(tracks: DataFrame) -> DataFrame:
    """seq and the text line of each track row, in frame and id order within a sequence; negative ids are left out."""
    line = F.format_string("%d,%d,%.1f,%.1f,%.1f,%.1f,%.2f,-1,-1,-1", *[F.col(c) for c in ("frame", "id", "x", "y", "w", "h", "score")])
    out = tracks.filter("id >= 0").select("seq", "frame", "id", line.alias("value"))
    return out.repartition("seq").sortWithinPartitions("seq", "frame", "id").select("seq", "value")


def write_tracks(tracks: DataFrame, path: str) -> None:
    """One folder of text for each sequence."""
    format_tracks(tracks).write.mode("overwrite").partitionBy("seq").text(path)


_VEHICLE_FRAME = "_num INT, target_list STRUCT<target: ARRAY<STRUCT<_id: INT, box: STRUCT<_left: DOUBLE, _top: DOUBLE, _width: DOUBLE, _height: DOUBLE>, attribute: STRUCT<_vehicle_type: STRING>>>>"


def read_vehicle_xml(spark: SparkSession, path: str, classes: dict[str, int], default: int = 4) -> DataFrame:
    """Box rows of frame elements with target lists: id, box and vehicle type, unknown types to the default class."""
    return vehicle_boxes(spark.read.schema(_VEHICLE_FRAME).option("rowTag", "frame").xml(path), classes, default)


def parse_vehicle_xml(texts: DataFrame, classes: dict[str, int], value: str = "value", default: int = 4) -> DataFrame:
    """Box rows of texts that hold one frame element each; other columns are kept."""
    return vehicle_boxes(texts.withColumn("__frame", F.from_xml(F.col(value), _VEHICLE_FRAME)).select(*[c for c in texts.columns if c != value], "__frame.*"), classes, default)


def vehicle_boxes(frames: DataFrame, classes: dict[str, int], default: int = 4) -> DataFrame:
    keep = [c for c in frames.columns if c not in ("_num", "target_list")]
    t = frames.select(*keep, F.col("_num").alias("frame"), F.explode("target_list.target").alias("t"))
    mapping = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    return t.select(*keep, "frame", F.col("t._id").alias("id"), F.col("t.box._left").alias("x"), F.col("t.box._top").alias("y"), F.col("t.box._width").alias("w"), F.col("t.box._height").alias("h"), F.lit(1.0).alias("conf"), F.coalesce(mapping[F.lower("t.attribute._vehicle_type")], F.lit(default)).alias("cls"))


def read_frame_tables(spark: SparkSession, path: str) -> DataFrame:
    """One CSV per frame (classID, trackID, x, y, w, h): native frame numbers become dense ranks; rows that don't parse are skipped."""
    raw = spark.read.option("header", "true").csv(path).withColumn("native", frame_number(F.col("_metadata.file_path")))
    return rank_frames(raw.select("native", *[F.col(c).try_cast("double").alias(c) for c in ("classID", "trackID", "x", "y", "w", "h")]))


def rank_frames(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of per-frame tables with their native frame number: incomplete rows go, native numbers become dense ranks (within ``keys``)."""
    typed = rows.dropna()
    order = typed.select(*keys, "native").distinct().withColumn("frame", F.row_number().over(Window.partitionBy(*keys).orderBy("native")))  # a row per file
    return typed.join(order, [*keys, "native"]).select(*keys, "frame", F.col("trackID").cast("int").alias("id"), "x", "y", "w", "h", F.lit(1.0).alias("conf"), F.col("classID").cast("int").alias("cls"))


def prefer(candidates: DataFrame, order: list[str]) -> DataFrame:
    """The first existing source of each sequence by an order of preference (columns seq, kind)."""
    rank = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("kind"))
    best = F.row_number().over(Window.partitionBy("seq").orderBy(rank))
    return candidates.filter(rank > 0).withColumn("r", best).filter("r = 1").drop("r")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Box rows of COCO-style JSON: images, and annotations with a track id and a bbox array."""
    schema = "images ARRAY<STRUCT<id: BIGINT, video_id: BIGINT, frame_index: INT>>, annotations ARRAY<STRUCT<image_id: BIGINT, track_id: BIGINT, category_id: INT, bbox: ARRAY<DOUBLE>>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), F.col("i.video_id").alias("seq"), F.col("i.frame_index").alias("frame"))
    a = doc.select(F.explode("annotations").alias("a")).select("a.*")
    box = [F.col("bbox")[i].alias(c) for i, c in enumerate(("x", "y", "w", "h"))]
    return a.join(images, "image_id").select("seq", "frame", F.col("track_id").alias("id"), *box, F.lit(1.0).alias("conf"), F.col("category_id").alias("cls"))


#: Labels of older benchmark files: pedestrians, and what is neither right nor wrong. Fixed values.
PEDESTRIAN, IGNORED_LABELS = 1, (2, 7, 8, 12)


def legacy_rows(lines: DataFrame, kind: str) -> DataFrame:
    """frame, id, x, y, w, h, score of old-style lines (value; comma-separated frame, id, box, mark, label, visibility).

    ``kind`` "truth": pedestrians that are marked, with score 1; "ignore": what is labelled neither right nor wrong, or has a
    negative visibility, with score 1; "result": all rows, with the seventh field as their score. Frames below 1 and lines of
    fewer fields go.
    """
    part = F.split("value", ",")
    number = lambda k: F.get(part, F.lit(k)).try_cast("double")
    mark, label, visible = number(6), number(7), number(8)
    keep = {"truth": (mark != 0) & (label == PEDESTRIAN), "ignore": label.isin(*IGNORED_LABELS) | (visible < 0), "result": F.lit(True)}[kind]
    rows = lines.filter((F.size(part) >= 7) & (number(0) >= 1)).filter(keep)
    score = mark if kind == "result" else F.lit(1.0)
    kept = [c for c in lines.columns if c != "value"]
    return rows.select(*kept, number(0).cast("long").alias("frame"), number(1).cast("long").alias("id"), *[number(k).alias(c) for k, c in enumerate("xywh", 2)], score.alias("score"))


def check_frames(boxes: DataFrame, meta: DataFrame, length: str = "seq_length") -> DataFrame:
    """``boxes``, failing at run time on frames outside 1..length of their sequence."""
    both = boxes.join(meta.select("seq", F.col(length).alias("__n")), "seq", "left")
    bad = (F.col("frame") < 1) | (F.col("frame") > F.col("__n"))
    return both.withColumn("frame", F.when(bad, F.raise_error(F.concat(F.lit("frame out of range in "), "seq")).cast("int")).otherwise(F.col("frame"))).drop("__n")
