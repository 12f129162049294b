"""Readers and writers over text derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..registry import query
from ..sources import mot as M

#: Ragged text of the ground truth: commas or blanks by id, short and long rows, negative confidences.
_LINE = """CASE id % 4 WHEN 0 THEN concat_ws(',', frame, id, x, y, w, h, -1) WHEN 1 THEN concat_ws(' ', frame, id, x, y, w, h, 0.5, id % 3, 'full') WHEN 2 THEN concat_ws(',', frame, id, x, y) ELSE concat_ws(', ', frame, id, x, y, w, h, 1, id % 3) END"""


def _lines(spark, sf_dir):
    return V.ground_truth(spark, sf_dir).select("seq", F.expr(_LINE).alias("value"))


@query("SRC1 SRC3 SRC16 SRC26", f"WITH {V.GT} SELECT seq, frame::INT AS frame, id::INT AS id, x, w, CASE id % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 ELSE 1 END::DOUBLE AS conf, CASE WHEN id % 4 <> 0 THEN id % 3 END::INT AS cls, CASE WHEN id % 4 = 1 THEN 'full' END AS visibility FROM gt WHERE id % 4 <> 2 AND (id % 4 = 0 OR id % 3 <> 2)")
def box_text_scan(spark, sf_dir):
    boxes = M.parse_lines(_lines(spark, sf_dir), conf_default=0.9)
    return M.filter_rows(boxes, drop={2}).select("seq", "frame", "id", "x", "w", "conf", "cls", "visibility")


@query("SRC3 SRC17", f"WITH {V.GT} SELECT seq, frame::INT AS frame, x AS x1, x + w AS x2, coalesce(CASE WHEN id % 4 <> 0 THEN id % 3 END, 0)::INT AS cls FROM gt WHERE id % 4 <> 2 AND coalesce(CASE WHEN id % 4 <> 0 THEN id % 3 END, 0) IN (0, 1)")
def detection_scan(spark, sf_dir):
    """A missing class counts as 0 and takes part in the policy."""
    seqs = M.parse_lines(_lines(spark, sf_dir))
    cls = F.coalesce(F.col("cls"), F.lit(0))
    return seqs.withColumn("cls", cls).filter(cls.isin(0, 1)).select("seq", "frame", F.col("x").alias("x1"), (F.col("x") + F.col("w")).alias("x2"), "cls")


@query("SRC7 SRC9", "SELECT p_partkey, greatest(1, round_even(CASE WHEN p_size % 10 = 0 THEN 30 ELSE p_size END / 10.0, 0))::INT AS step, CASE WHEN p_partkey % 3 = 0 THEN 5 WHEN p_partkey % 3 = 1 THEN greatest(1, round_even(CASE WHEN p_size % 10 = 0 THEN 30 ELSE p_size END / 10.0, 0)) ELSE 1 END::INT AS planned FROM part")
def frame_strides(spark, sf_dir):
    """Rates that are multiples of ten stand for unknown ones here."""
    p = V.table(spark, sf_dir, "part")
    native = F.when(F.col("p_size") % 10 == 0, F.lit(0.0)).otherwise(F.col("p_size").cast("double"))
    explicit, target = F.when(F.col("p_partkey") % 3 == 0, 5), F.when(F.col("p_partkey") % 3 == 1, 10.0)
    return p.select("p_partkey", M.stride(native, F.lit(10.0)).alias("step"), M.schedule(explicit, native, target).alias("planned"))


@query("SRC8 SRC27", f"WITH {V.GT}, s AS (SELECT seq, max(frame) AS n FROM gt GROUP BY seq) SELECT seq, unnest(range(1, n + 1, seq + 1))::BIGINT AS frame FROM s")
def kept_frames(spark, sf_dir):
    s = V.ground_truth(spark, sf_dir).groupBy("seq").agg(F.max("frame").alias("n")).withColumns({"step": F.col("seq") + 1, "n": F.col("n")})
    return s.withColumn("frame", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"), F.col("step")))).select("seq", "frame")


@query("SRC6", "SELECT page_id, try_cast(nullif(regexp_replace(regexp_extract(url, '([^/]+?)(\\.[^./]*)?$', 1), '[^0-9]', '', 'g'), '') AS BIGINT) AS number FROM pages")
def stem_numbers(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", M.frame_number(F.col("url")).alias("number"))


@query("SRC13", "WITH c AS (SELECT user_id AS seq, event_type AS kind FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY list_position(['signup', 'purchase', 'view'], kind)) AS r FROM c WHERE kind IN ('signup', 'purchase', 'view')) SELECT seq, kind FROM r WHERE r = 1")
def preferred_source(spark, sf_dir):
    c = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("seq"), F.col("event_type").alias("kind")).distinct()
    return M.prefer(c, ["signup", "purchase", "view"])


@query("SNK1 SNK2", f"WITH {V.TRK} SELECT seq, printf('%d,%d,%.1f,%.1f,%.1f,%.1f,%.2f,-1,-1,-1', frame, id, x, y, w, h, 0.5) AS value FROM trk")
def track_lines(spark, sf_dir):
    return M.format_tracks(V.tracks(spark, sf_dir).withColumn("score", F.lit(0.5)))


@query("SNK9", "SELECT user_id % 8 AS camera, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL")
def metadata_assembly(spark, sf_dir):
    """A nested record per camera, assembled, written as JSON text, and read back."""
    e = V.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).alias("camera")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    record = F.to_json(F.struct("camera", F.struct("n", "first").alias("counts")))
    back = F.from_json(record, "camera bigint, counts struct<n: bigint, first: bigint>")
    return e.select(back.alias("r")).select("r.camera", "r.counts.n", "r.counts.first")


@query("SRC20", f"WITH {V.DET}, c AS (SELECT * FROM (VALUES (0, 'person'), (1, 'car'), (2, 'truck'), (3, 'bag')) t(cls, object)) SELECT seq, coalesce(object, 'other') AS object, count(*) AS n FROM det LEFT JOIN c USING (cls) GROUP BY ALL")
def class_taxonomy(spark, sf_dir):
    c = spark.createDataFrame([(0, "person"), (1, "car"), (2, "truck"), (3, "bag")], "cls long, object string")
    d = V.detections(spark, sf_dir).join(F.broadcast(c), "cls", "left")
    return d.groupBy("seq", F.coalesce("object", F.lit("other")).alias("object")).agg(F.count(F.lit(1)).alias("n"))


@query("UDF4", f"WITH {V.PAIRS}, m AS (SELECT seq, tid AS id, count(*) AS n FROM hit WHERE gid % 9 = 0 GROUP BY ALL), k AS (SELECT DISTINCT seq, id FROM trk t WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.seq = t.seq AND m.id = t.id)) SELECT seq, id, dense_rank() OVER (PARTITION BY seq ORDER BY id) AS label FROM k")
def distractor_removal(spark, sf_dir):
    """Tracks that match a distractor (every ninth ground truth id) go; the rest is relabelled densely."""
    from pyspark.sql import Window

    from ..operators.pairs import frame_pairs

    gt, trk = V.ground_truth(spark, sf_dir), V.tracks(spark, sf_dir)
    bad = frame_pairs(gt.filter("id % 9 = 0"), trk, least=0.5).select("seq", F.col("tid").alias("id")).distinct()
    kept = trk.select("seq", "id").distinct().join(bad, ["seq", "id"], "left_anti")
    return kept.withColumn("label", F.dense_rank().over(Window.partitionBy("seq").orderBy("id")).cast("long"))
