"""Formats that are exchanged, joined records, and classes put together."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import views as V
from ..functions import boxes as B
from ..functions.rounding import rounded
from ..operators.pairs import frame_pairs
from ..registry import query
from ..sources import federated as S
from ..sources import mot as M


def one():
    """Counts rows."""
    return F.count(F.lit(1))


def annotated(spark, sf_dir):
    """A JSON document for each sequence and day, so that none grows with the recording: two of five classes annotated, one listed as absent, one annotated in part."""
    g = V.ground_truth(spark, sf_dir).withColumn("cls", F.col("id") % 5).filter("(cls + seq) % 5 < 3")
    image = F.col("frame") + 10_000 * F.col("seq")
    rows = g.select("seq", F.struct(image.alias("id"), F.col("seq").alias("video_id"), F.col("frame").alias("frame_index")).alias("i"), F.struct(F.col("id").alias("id"), F.col("cls").alias("category_id"), F.col("seq").alias("video_id")).alias("t"), F.struct((F.col("id") * 1000 + F.col("frame")).alias("id"), image.alias("image_id"), F.col("id").alias("track_id"), F.array("x", "y", "w", "h").alias("bbox")).alias("a"))
    doc = rows.groupBy("seq", F.floor(F.col("i.frame_index") / 24)).agg(F.collect_set("i").alias("images"), F.collect_set("t").alias("tracks"), F.collect_list("a").alias("annotations"))
    listed = lambda k: F.array(F.pmod(F.lit(k) - F.col("seq"), F.lit(5)))
    video = F.array(F.struct(F.col("seq").alias("id"), F.concat(F.lit("v"), F.col("seq").cast("string")).alias("name"), listed(3).alias("neg_category_ids"), listed(2).alias("not_exhaustive_category_ids")))
    return doc.select(F.to_json(F.struct(video.alias("videos"), "images", "tracks", "annotations")).alias("value"))


@query("SRC29", f"""WITH {V.TRK}, g AS (SELECT *, id % 5 AS cls FROM gt WHERE (id % 5 + seq) % 5 < 3), d AS (SELECT *, id % 5 AS cls FROM trk),
j AS (SELECT d.seq, d.cls, CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.seq = d.seq AND g.frame = d.frame AND g.cls = d.cls AND
    greatest(0, least(g.x + g.w, d.x + d.w) - greatest(g.x, d.x)) * greatest(0, least(g.y + g.h, d.y + d.h) - greatest(g.y, d.y)) * 3 >= g.w * g.h + d.w * d.h) THEN 'right'
  WHEN (d.cls + d.seq) % 5 = 3 OR (d.cls + d.seq) % 5 < 2 AND EXISTS (SELECT 1 FROM g WHERE g.seq = d.seq AND g.cls = d.cls) THEN 'wrong' ELSE 'ignored' END AS verdict FROM d)
SELECT seq, cls, verdict, count(*) AS n FROM j GROUP BY ALL""")  # fmt: skip
def federated_verdicts(spark, sf_dir):
    """Detections of each class that are right, wrong, or can't be judged, by annotations that say what they leave out."""
    gt, videos = S.parse_federated(annotated(spark, sf_dir))
    det = V.tracks(spark, sf_dir).withColumn("cls", F.col("id") % 5)
    return S.judged(gt, det, videos.distinct()).groupBy("seq", "cls", "verdict").agg(one().alias("n"))


@query("RET12", f"""WITH {V.DET}, b AS (SELECT seq, frame, id, x - 5 + cell % 9 AS l, y + cell // 32 * 15 AS t FROM det), c AS (SELECT *, l + 40 AS r, t + 30 AS u FROM b), k AS (SELECT *, least(640 / 1280, 640 / 720) AS gain FROM c)
SELECT seq, frame, id, round((l + r) / 2 / 640, 6) AS cx, round((t + u) / 2 / 640, 6) AS cy, round(40 / 640, 6) AS nw, round(greatest(0, least((l - (640 - 1280 * gain) / 2) / gain, 1280)), 6) AS sl, round(greatest(0, least((t - (640 - 720 * gain) / 2) / gain, 720)), 6) AS st,
  round(greatest(0, least((r - (640 - 1280 * gain) / 2) / gain, 1280)), 6) AS sr, round(greatest(0, least((u - (640 - 720 * gain) / 2) / gain, 720)), 6) AS su FROM k""")  # fmt: skip
def box_transforms(spark, sf_dir):
    """Boxes of a square picture as shares of it, and in the picture that it was fitted from, clipped."""
    d = V.detections(spark, sf_dir).withColumns({"x": F.col("x") - 5 + F.col("cell") % 9, "y": F.col("y") + F.floor(F.col("cell") / 32) * 15})
    size = lambda w, h: (F.lit(float(w)), F.lit(float(h)))
    share, back = B.normalised(B.box(), *size(640, 640)), B.rescaled(B.box(), size(640, 640), size(1280, 720))
    return d.select("seq", "frame", "id", *[rounded(c, 6).alias(n) for c, n in zip([*share[:3], *back], ["cx", "cy", "nw", "sl", "st", "sr", "su"], strict=True)])


@query("RET18", f"""WITH {V.GT} SELECT seq, frame, id, concat_ws(' ', frame - 1, id, CASE id % 3 WHEN 0 THEN 'Car' WHEN 1 THEN 'Pedestrian' ELSE 'Cyclist' END, 0, 0, -10, printf('%.1f', x), printf('%.1f', y), printf('%.1f', x + w), printf('%.1f', y + h)) AS line FROM gt""")
def nested_to_lines(spark, sf_dir):
    """Nested labels of frames (category, id, corners) and, from them, a line of text per box; frames count from zero there."""
    g = V.ground_truth(spark, sf_dir)
    corners = F.struct(F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    name = F.element_at(F.array(F.lit("car"), F.lit("pedestrian"), F.lit("rider")), (F.col("id") % 3 + 1).cast("int"))
    nested = g.groupBy("seq", "frame").agg(F.collect_list(F.struct(F.col("id").alias("id"), name.alias("category"), corners.alias("box2d"))).alias("labels"))
    b = nested.select("seq", "frame", F.explode("labels").alias("b")).select("seq", "frame", "b.*")
    kind = F.when(F.col("category") == "car", "Car").when(F.col("category") == "pedestrian", "Pedestrian").otherwise("Cyclist")
    at = [F.format_string("%.1f", F.col(f"box2d.{c}")) for c in ("x1", "y1", "x2", "y2")]
    return b.select("seq", "frame", "id", F.concat_ws(" ", (F.col("frame") - 1).cast("string"), F.col("id").cast("string"), kind, F.lit("0"), F.lit("0"), F.lit("-10"), *at).alias("line"))


@query("AGG44", f"""WITH {V.PAIRS}, n AS (SELECT id % 5 AS cls, count(*) AS gt FROM gt GROUP BY 1), d AS (SELECT id % 5 AS cls, count(*) AS det FROM trk GROUP BY 1), h AS (SELECT gid % 5 AS cls, count(DISTINCT (seq, frame, gid)) AS tp FROM hit WHERE gid % 5 = tid % 5 GROUP BY 1),
c AS (SELECT cls, coalesce(tp, 0) AS tp, gt - coalesce(tp, 0) AS fn, det - coalesce(tp, 0) AS fp FROM n JOIN d USING (cls) LEFT JOIN h USING (cls)), s AS (SELECT *, CASE WHEN cls < 2 THEN 'person' ELSE 'vehicle' END AS super FROM c)
SELECT 'cls ' || cls AS scope, tp::DOUBLE AS tp, fn::DOUBLE AS fn, fp::DOUBLE AS fp, round(tp / (tp + fn + fp), 6) AS score FROM c UNION ALL
SELECT 'class-averaged', avg(tp), avg(fn), avg(fp), round(avg(tp / (tp + fn + fp)), 6) FROM c UNION ALL SELECT 'detection-averaged', sum(tp), sum(fn), sum(fp), round(sum(tp) / sum(tp + fn + fp), 6) FROM c UNION ALL
SELECT 'super ' || super, sum(tp), sum(fn), sum(fp), round(sum(tp) / sum(tp + fn + fp), 6) FROM s GROUP BY super""")  # fmt: skip
def class_combinations(spark, sf_dir):
    """Detection accuracy of each class, averaged over classes, over detections, and over detections of super-categories."""
    gt, trk = V.ground_truth(spark, sf_dir), V.tracks(spark, sf_dir)
    cls = lambda c: F.col(c) % 5
    hit = frame_pairs(gt, trk, least=0.5).filter(cls("gid") == cls("tid")).select("seq", "frame", "gid").distinct().groupBy(cls("gid").alias("cls")).agg(one().alias("tp"))
    n, d = (t.groupBy(cls("id").alias("cls")).agg(one().alias(name)) for t, name in ((gt, "gt"), (trk, "det")))
    tp = F.coalesce("tp", F.lit(0))
    c = n.join(d, "cls").join(hit, "cls", "left").select("cls", tp.cast("double").alias("tp"), (F.col("gt") - tp).cast("double").alias("fn"), (F.col("det") - tp).cast("double").alias("fp"))
    kinds = ["tp", "fn", "fp"]
    score = F.col("tp") / (F.col("tp") + F.col("fn") + F.col("fp"))
    finish = lambda t: t.select("scope", *kinds, F.round(score, 6).alias("score"))
    label = F.concat(F.lit("super "), F.when(F.col("cls") < 2, "person").otherwise("vehicle"))
    each = finish(c.withColumn("scope", F.concat(F.lit("cls "), F.col("cls").cast("string"))))
    mean = c.agg(*[F.avg(k).alias(k) for k in kinds], F.round(F.avg(score), 6).alias("score")).select(F.lit("class-averaged").alias("scope"), *kinds, "score")
    summed = lambda t: finish(t.agg(*[F.sum(k).alias(k) for k in kinds]))
    return each.unionByName(mean).unionByName(summed(c.groupBy(F.lit("detection-averaged").alias("scope")))).unionByName(summed(c.groupBy(label.alias("scope"))))


@query("SRC19", """WITH a AS (SELECT c_custkey AS k, c_mktsegment AS kind, 0 AS rank FROM customer), b AS (SELECT s_suppkey AS k, 'supplier' AS kind, 1 AS rank FROM supplier), c AS (SELECT p_partkey AS k, p_type AS kind, 2 AS rank FROM part WHERE p_size > 40),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rank DESC) AS n FROM u) SELECT k, kind, rank::INT AS source FROM r WHERE n = 1""")  # fmt: skip
def dimension_override(spark, sf_dir):
    """Rows of several sources by key; later sources override earlier ones, as a maximum before the shuffle."""
    t = lambda name: V.table(spark, sf_dir, name)
    sources = [t("customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("kind")), t("supplier").select(F.col("s_suppkey").alias("k"), F.lit("supplier").alias("kind")), t("part").filter("p_size > 40").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("kind"))]
    every = None
    for rank, s in enumerate(sources):
        one_ = s.withColumn("source", F.lit(rank))
        every = one_ if every is None else every.unionByName(one_)
    return every.groupBy("k").agg(F.max(F.struct("source", "kind")).alias("r")).select("k", "r.kind", "r.source")


@query("SNK9", f"""WITH {V.EV}, e AS (SELECT *, user_id % 8 AS camera, ms // 3600000 AS hour FROM ev), t AS (SELECT camera, hour, count(*) AS events, count(DISTINCT user_id) AS entities, max(value) AS motion FROM e GROUP BY ALL),
a AS (SELECT camera, hour, count(*) AS alerts, min(event_id) AS first_alert FROM e WHERE event_type = 'error' GROUP BY ALL), p AS (SELECT camera, hour + 1 AS hour, entities AS before FROM t)
SELECT camera, hour, coalesce(events, 0) AS events, coalesce(entities, 0) AS entities, motion, coalesce(alerts, 0) AS alerts, first_alert, coalesce(before, 0) AS before FROM t LEFT JOIN a USING (camera, hour) FULL JOIN p USING (camera, hour)""")  # fmt: skip
def hourly_records(spark, sf_dir):
    """Timeline, alerts, entities, motion and counts of the hour before, joined into a record for each camera and hour."""
    e = V.events(spark, sf_dir).select("*", (F.col("user_id") % 8).alias("camera"), F.floor(F.col("ms") / 3_600_000).alias("hour"))
    key = ["camera", "hour"]
    t = e.groupBy(*key).agg(one().alias("events"), F.countDistinct("user_id").alias("entities"), F.max("value").alias("motion"))
    a = e.filter("event_type = 'error'").groupBy(*key).agg(one().alias("alerts"), F.min("event_id").alias("first_alert"))
    p = t.select("camera", (F.col("hour") + 1).alias("hour"), F.col("entities").alias("before"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    record = F.struct("camera", "hour", zero("events"), zero("entities"), "motion", zero("alerts"), "first_alert", zero("before"))
    joined = t.join(a, key, "left").join(p, key, "full")
    return joined.select(record.alias("record")).select("record.*")


@query("FLT25", f"""WITH {V.EV}, c AS (SELECT user_id % 8 AS account, ms, event_id, CASE WHEN event_type = 'purchase' THEN 'armed' WHEN value >= 50 THEN 'off' ELSE 'paused' END AS mode FROM ev WHERE event_type IN ('purchase', 'error')),
n AS (SELECT *, lead(ms) OVER (PARTITION BY account ORDER BY ms, event_id) AS until FROM c), q AS (SELECT event_id AS id, user_id % 8 AS account, ms FROM ev WHERE event_type = 'view')
SELECT q.id, coalesce(CASE WHEN mode = 'paused' AND q.ms >= n.ms + 7200000 THEN 'armed' ELSE mode END, 'armed') AS mode, mode = 'paused' AND q.ms >= n.ms + 7200000 AS rearmed
FROM q LEFT JOIN n ON q.account = n.account AND n.ms <= q.ms AND (n.until > q.ms OR n.until IS NULL)""")  # fmt: skip
def armed_at(spark, sf_dir):
    """Mode of an account at each view: the latest change, unless a pause has run out, which arms it again after two hours. One sorted pass per account."""
    e = V.events(spark, sf_dir).withColumn("account", F.col("user_id") % 8)
    mode = F.when(F.col("event_type") == "purchase", "armed").when(F.col("event_type") == "error", F.when(F.col("value") >= 50, "off").otherwise("paused"))
    change = F.when(mode.isNotNull(), F.struct(F.col("ms").alias("at"), mode.alias("mode")))
    # At equal times a change comes before a view.
    by = Window.partitionBy("account").orderBy("ms", F.col("event_type") == "view", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    s = e.withColumn("c", F.last(change, ignorenulls=True).over(by)).filter("event_type = 'view'")
    over = (F.col("c.mode") == "paused") & (F.col("ms") >= F.col("c.at") + 7_200_000)
    return s.select(F.col("event_id").alias("id"), F.coalesce(F.when(over, "armed").otherwise(F.col("c.mode")), F.lit("armed")).alias("mode"), over.alias("rearmed"))


@query("RET16", f"""WITH {V.DET}, l AS (SELECT seq, frame, id, x, y, w, h, id % 7 AS mark, id % 13 AS label, (cell % 10 - 1) / 10 AS vis FROM det WHERE id % 17 <> 0)
SELECT seq, 'truth' AS kind, frame, id, x, 1.0::DOUBLE AS score FROM l WHERE mark <> 0 AND label = 1 UNION ALL SELECT seq, 'ignore', frame, id, x, 1.0 FROM l WHERE label IN (2, 7, 8, 12) OR vis < 0 UNION ALL SELECT seq, 'result', frame, id, x, mark FROM l""")  # fmt: skip
def legacy_rows(spark, sf_dir):
    """Old-style lines, read as ground truth, as regions to ignore, and as results; short lines go."""
    d = V.detections(spark, sf_dir)
    line = F.concat_ws(",", "frame", "id", *[F.col(c).cast("string") for c in "xywh"], F.col("id") % 7, F.col("id") % 13, (F.col("cell") % 10 - 1) / 10)
    lines = d.select("seq", F.when(F.col("id") % 17 == 0, F.lit("1,2,3")).otherwise(line).alias("value"))
    out = None
    for kind in ("truth", "ignore", "result"):
        one_ = M.legacy_rows(lines, kind).select("seq", F.lit(kind).alias("kind"), "frame", "id", "x", "score")
        out = one_ if out is None else out.unionByName(one_)
    return out
