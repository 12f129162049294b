"""Filters, projections and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import views as V
from ..functions.boxes import box
from ..functions import boxes as B
from ..operators import filters as O
from ..registry import query

D = f"WITH {V.DET}"


@query("FLT1 FLT2", f"{D} SELECT seq, frame, id, cls FROM det WHERE cls NOT IN (3, 4) AND cls IN (0, 1)")
def class_policy(spark, sf_dir):
    keep, drop = O.resolve_policy({0, 1, 3}, {4}, {3})
    return V.detections(spark, sf_dir).filter(O.by_policy(F.col("cls"), keep, drop)).select("seq", "frame", "id", "cls")


@query("FLT3", f"{D} SELECT seq, frame, id, CASE cls WHEN 0 THEN 10 WHEN 1 THEN 11 WHEN 2 THEN 11 ELSE 99 END AS subclass FROM det")
def class_remap(spark, sf_dir):
    return V.detections(spark, sf_dir).select("seq", "frame", "id", O.remap(F.col("cls"), {0: 10, 1: 11, 2: 11}, 99).alias("subclass"))


@query("FLT4 FLT6 SRC24", f"{D} SELECT id, frame, score FROM det WHERE cls = 2")
def batch_query(spark, sf_dir):
    return V.detections(spark, sf_dir).filter(F.col("cls") == 2).select("id", "frame", "score")


@query("FLT5 FLT12", f"{D} SELECT seq, id, frame FROM det WHERE cls IN (0, 2) AND seq = 3 AND frame BETWEEN 100 AND 199")
def batch_advance_query(spark, sf_dir):
    return O.advance(V.detections(spark, sf_dir), cls=[0, 2], seq=3, frame=range(100, 200)).select("seq", "id", "frame")


@query("FLT7", f"{D} SELECT seq, frame, id, cell FROM det WHERE cell < 256")
def roi_filter(spark, sf_dir):
    return V.detections(spark, sf_dir).filter(F.col("cell") < 256).select("seq", "frame", "id", "cell")


@query("FLT8", f"{D} SELECT seq, frame, id, CASE WHEN cell < 256 THEN 'green' WHEN cell < 512 THEN 'red' END AS zone FROM det WHERE cell < 512")
def two_zone_split(spark, sf_dir):
    d = V.detections(spark, sf_dir).withColumn("zone", O.zone(F.floor(F.col("cell") / 256), [0], [1]))
    return d.filter(F.col("zone").isNotNull()).select("seq", "frame", "id", "zone")


@query("FLT9 SCL2", f"""{D}, c AS (SELECT seq, frame, id, greatest(0, least(31, CAST(floor((x + w / 2) / 1000 * 32) AS BIGINT))) AS col, greatest(0, least(31, CAST(floor((y + h) / 600 * 32) AS BIGINT))) AS row,
  greatest(0, least(31, CAST(floor((y + h / 2) / 600 * 32) AS BIGINT))) AS mid FROM det)
SELECT seq, frame, id, row * 32 + col AS bottom_cell, mid * 32 + col AS centre_cell, (row * 32 + col) % 3 = 0 OR (mid * 32 + col) % 5 = 0 AS inside FROM c""")  # fmt: skip
def roi_cells(spark, sf_dir):
    d = V.detections(spark, sf_dir)
    bottom, centre = B.cell(box(), 1000, 600), B.cell(box(), 1000, 600, from_centre=True)
    return d.select("seq", "frame", "id", bottom.alias("bottom_cell"), centre.alias("centre_cell")).withColumn("inside", (F.col("bottom_cell") % 3 == 0) | (F.col("centre_cell") % 5 == 0))


@query("FLT10 FLT11 SCL21", """SELECT event_id, event_type IN ('click', 'view') AND CAST(json_extract(props, '$.k') AS BIGINT) IN (1, 2, 3) AS strict,
  CAST(json_extract(props, '$.k') AS BIGINT) IN (1, 2, 3) AS loose FROM events""")  # fmt: skip
def attribute_filters(spark, sf_dir):
    """Across keys all must match, within a key any value; a key that is absent passes only where matching isn't strict."""
    e = V.table(spark, sf_dir, "events")
    have = F.create_map(F.lit("type"), F.array("event_type"), F.lit("k"), F.array(F.get_json_object("props", "$.k")))
    strict = O.attributes_match(have, {"type": ["click", "view"], "k": ["1", "2", "3"]}, strict=True)
    return e.select("event_id", strict.alias("strict"), O.attributes_match(have, {"k": ["1", "2", "3"], "colour": ["red"]}).alias("loose"))


@query("FLT13", f"{D} SELECT seq, frame, id FROM det d WHERE cls IN (0, 1) AND id > 0 AND cell < 512 AND NOT EXISTS (SELECT 1 FROM det e WHERE e.seq = d.seq AND e.frame = d.frame AND e.cls = 4)")
def batch_candidates(spark, sf_dir):
    """Class, tracked and region filters, and an anti join on frames where a blocking class is present."""
    d = V.detections(spark, sf_dir)
    block = d.filter(F.col("cls") == 4).select("seq", "frame")
    return d.filter(F.col("cls").isin(0, 1) & (F.col("id") > 0) & (F.col("cell") < 512)).join(block, ["seq", "frame"], "left_anti").select("seq", "frame", "id")


@query("FLT14", f"""{D}, b AS (SELECT seq, frame, id, cls, (id % 3) * 15.0 AS x, w FROM det)
SELECT seq, frame, id FROM b p WHERE cls = 0 AND NOT EXISTS (SELECT 1 FROM b v WHERE v.seq = p.seq AND v.frame = p.frame AND v.cls IN (2, 3)
  AND greatest(0, least(p.x + p.w, v.x + v.w) - greatest(p.x, v.x)) / p.w > 0.6)""")  # fmt: skip
def person_not_in_vehicle(spark, sf_dir):
    d = V.detections(spark, sf_dir).withColumn("x", (F.col("id") % 3) * 15.0)
    kept = O.without_contained(d.filter(F.col("cls") == 0), d.filter(F.col("cls").isin(2, 3)), ["seq", "frame"], 0.6)
    return kept.select("seq", "frame", "id")


@query("FLT15 STR7", """SELECT event_id, CASE WHEN value > 60 THEN true WHEN event_type = 'error' THEN false END AS valid FROM events""")
def three_valued_validity(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    return e.select("event_id", F.when(F.col("value") > 60, True).when(F.col("event_type") == "error", False).alias("valid"))


@query("FLT16 SET4", f"""WITH {V.EV}, s AS (SELECT user_id, list_distinct(list(CAST(json_extract(props, '$.k') AS BIGINT))) AS ids, count(*) AS n FROM ev GROUP BY user_id)
SELECT user_id, CASE WHEN list_has_any(ids, [7, 8]) AND n % 2 = 0 THEN false WHEN list_has_any(ids, [1, 2]) THEN true WHEN n > 60 THEN false END AS matched,
  len(list_filter(list_distinct(list_concat(ids, [1, 2])), lambda x: x NOT IN (7, 8)))::BIGINT AS left_over FROM s""")  # fmt: skip
def custom_object_predicate(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    s = V.table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(k).alias("ids"), F.count(F.lit(1)).alias("n"))
    negative = F.when(F.col("n") % 2 == 0, F.col("ids")).otherwise(F.array().cast("array<bigint>"))
    decided = F.when(F.arrays_overlap(negative, F.array(F.lit(7).cast("bigint"), F.lit(8).cast("bigint"))), False).otherwise(O.custom_object_match(F.col("ids"), [1, 2], [], F.col("n") > 60))
    left = F.array_except(F.array_union("ids", F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))), F.array(F.lit(7).cast("bigint"), F.lit(8).cast("bigint")))
    return s.select("user_id", decided.alias("matched"), F.size(left).cast("bigint").alias("left_over"))


@query("FLT17", f"{D} SELECT seq, id, count(DISTINCT cell) AS cells FROM det GROUP BY ALL HAVING count(DISTINCT cell) > 60")
def moved(spark, sf_dir):
    return V.detections(spark, sf_dir).groupBy("seq", "id").agg(F.countDistinct("cell").alias("cells")).filter("cells > 60")


@query("FLT18", f"{D} SELECT seq, frame, id FROM det WHERE w * h >= 1000 AND w >= 20 AND x >= 50 AND x + w <= 850")
def size_and_edge_filter(spark, sf_dir):
    x, w, h = F.col("x"), F.col("w"), F.col("h")
    return V.detections(spark, sf_dir).filter((w * h >= 1000) & (w >= 20) & (x >= 50) & (x + w <= 850)).select("seq", "frame", "id")


@query("FLT19 FLT21", f"""{D}, th AS (SELECT * FROM (VALUES (0, 0.2, 0.6), (1, 0.1, 0.5), (2, 0.3, 0.7), (3, -1, 0.8)) t(cls, low, high))
SELECT seq, frame, id, CASE WHEN score >= coalesce(high, 0.6) THEN 'high' WHEN score >= CASE WHEN coalesce(low, -1) < 0 THEN 0.25 ELSE low END THEN 'low' ELSE 'rejected' END AS stage
FROM det LEFT JOIN th USING (cls)""")  # fmt: skip
def score_split(spark, sf_dir):
    """Thresholds come from a per-class table (a fixed handful of rows), with defaults for classes it lacks or marks -1."""
    th = spark.createDataFrame([(0, 0.2, 0.6), (1, 0.1, 0.5), (2, 0.3, 0.7), (3, -1.0, 0.8)], "cls long, low double, high double")
    d = V.detections(spark, sf_dir).join(F.broadcast(th), "cls", "left")
    low = F.when(F.coalesce("low", F.lit(-1.0)) < 0, 0.25).otherwise(F.col("low"))
    return d.select("seq", "frame", "id", O.confidence_stage(F.col("score"), low, F.coalesce("high", F.lit(0.6))).alias("stage"))


@query("FLT20", f"""WITH {V.DET}, o AS (SELECT DISTINCT seq, frame, id FROM det WHERE id % 4 <> 0)
SELECT seq, frame, id FROM o UNION ALL SELECT seq, frame, -1 FROM det d WHERE score >= 0.5 AND NOT EXISTS (SELECT 1 FROM o WHERE o.seq = d.seq AND o.frame = d.frame AND o.id = d.id)""")  # fmt: skip
def untracked_passthrough(spark, sf_dir):
    d = V.detections(spark, sf_dir)
    owned = d.filter(F.col("id") % 4 != 0).select("seq", "frame", "id")
    rest = d.filter(F.col("score") >= 0.5).join(owned, ["seq", "frame", "id"], "left_anti").select("seq", "frame", F.lit(-1).cast("bigint").alias("id"))
    return owned.unionByName(rest)


@query("FLT22 AGG18", f"""{D}, m AS (SELECT cls, quantile_disc(w * h + frame % 7, 0.9) AS top FROM det GROUP BY cls) SELECT seq, frame, id FROM det JOIN m USING (cls) WHERE w * h + frame % 7 > top""")
def oversized_outliers(spark, sf_dir):
    """Boxes above their class's learnt size: the 90th percentile."""
    d = V.detections(spark, sf_dir).withColumn("size", F.col("w") * F.col("h") + F.col("frame") % 7)
    top = d.groupBy("cls").agg(F.expr("percentile_disc(0.9) within group (order by size)").alias("top"))
    return d.join(F.broadcast(top), "cls").filter("size > top").select("seq", "frame", "id")


@query("FLT23", f"{D} SELECT seq, frame, id, (score = max(score) OVER (PARTITION BY seq, id))::INT AS is_max FROM det")
def max_confidence_mask(spark, sf_dir):
    return O.max_mask(V.detections(spark, sf_dir), ["seq", "id"], "score").select("seq", "frame", "id", "is_max")


_SCHED = "CASE dayofweek(ts) WHEN 1 THEN true WHEN 3 THEN hour(ts) * 60 + minute(ts) BETWEEN 480 AND 1020 WHEN 5 THEN hour(ts) * 60 + minute(ts) BETWEEN 0 AND 300 OR hour(ts) * 60 + minute(ts) BETWEEN 1200 AND 1439 ELSE false END"


@query("FLT24 SCL10", f"SELECT event_id FROM events WHERE {_SCHED}")
def schedule_filter(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    day, minute = F.dayofweek("ts") - 1, F.hour("ts") * 60 + F.minute("ts")
    return e.filter(O.in_schedule(day, minute, {1: [(0, 0)], 3: [(480, 1020)], 5: [(0, 300), (1200, 1439)]})).select("event_id")


@query("FLT25 FLT26", f"""WITH s AS (SELECT *, {_SCHED} AS own, hour(ts) BETWEEN 6 AND 21 AS zone, user_id % 3 = 0 OR hour(ts) % 2 = 0 AS policies FROM events)
SELECT event_id, CASE WHEN user_id % 4 = 0 THEN own WHEN user_id % 4 = 1 THEN zone WHEN user_id % 4 = 2 THEN policies ELSE true END AS armed FROM s""")  # fmt: skip
def schedule_precedence(spark, sf_dir):
    """The alert's schedule goes before its zone's, that before any of its policies, and without any it is always on."""
    e = V.table(spark, sf_dir, "events")
    day, hour = F.dayofweek("ts") - 1, F.hour("ts")
    own = F.when(F.col("user_id") % 4 == 0, O.in_schedule(day, hour * 60 + F.minute("ts"), {1: [(0, 0)], 3: [(480, 1020)], 5: [(0, 300), (1200, 1439)]}))
    area = F.when(F.col("user_id") % 4 == 1, hour.between(6, 21))
    policies = F.when(F.col("user_id") % 4 == 2, (F.col("user_id") % 3 == 0) | (hour % 2 == 0))
    return e.select("event_id", F.coalesce(own, area, policies, F.lit(True)).alias("armed"))


@query("FLT27 STR26 STR48", """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms FROM events GROUP BY ALL),
a AS (SELECT user_id, min(ms) AS ms FROM e GROUP BY user_id
  UNION ALL SELECT a.user_id, (SELECT min(e.ms) FROM e WHERE e.user_id = a.user_id AND e.ms >= a.ms + 43200000) FROM a WHERE a.ms IS NOT NULL)
SELECT user_id, ms FROM a WHERE ms IS NOT NULL""")  # fmt: skip
def blockout_debounce(spark, sf_dir):
    """An event raises if it is 12 h or more after the last that raised."""
    return O.spaced(V.events(spark, sf_dir), ["user_id"], "ms", 12 * 3600 * 1000)


_FIND = """f AS (SELECT o_orderkey AS run_id, o_orderpriority AS detector, o_orderstatus AS tracker, o_custkey % 7 AS benchmark, CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '-' WHEN 2 THEN '7.5' ELSE '10' END AS fps, o_orderdate AS run_at, o_totalprice AS score FROM orders)"""


def findings(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    k = F.col("o_custkey") % 4
    fps = F.when(k == 0, "").when(k == 1, "-").when(k == 2, "7.5").otherwise("10")
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("detector"), F.col("o_orderstatus").alias("tracker"), (F.col("o_custkey") % 7).alias("benchmark"), fps.alias("fps"), F.col("o_orderdate").alias("run_at"), F.col("o_totalprice").alias("score"))


@query("FLT28 FLT29", f"WITH {_FIND} SELECT run_id, try_cast(fps AS DOUBLE) AS fps FROM f WHERE detector = '1-URGENT' AND contains(CAST(run_id AS VARCHAR), '7') AND abs(try_cast(fps AS DOUBLE) - 7.5) <= 1e-6")
def findings_filter(spark, sf_dir):
    f = findings(spark, sf_dir).withColumn("fps", O.normalize_fps(F.col("fps")))
    return f.filter((F.col("detector") == "1-URGENT") & F.col("run_id").cast("string").contains("7") & (F.abs(F.col("fps") - 7.5) <= 1e-6)).select("run_id", "fps")


@query("FLT28 FLT29", f"WITH {_FIND} SELECT run_id FROM f WHERE fps IN ('', '-') AND tracker = 'F'")
def findings_full_rate(spark, sf_dir):
    """No target rate asked for: only runs at the full rate, whose normalised rate is null."""
    return findings(spark, sf_dir).filter(O.normalize_fps(F.col("fps")).isNull() & (F.col("tracker") == "F")).select("run_id")


@query("FLT30", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority NOT IN ('5-LOW') AND o_custkey IS NOT NULL AND o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY")
def recent_orders(spark, sf_dir):
    return spark.sql("""SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority NOT IN ('5-LOW') AND o_custkey IS NOT NULL
      AND o_orderdate >= (SELECT max(o_orderdate) FROM {orders}) - INTERVAL 90 DAY""", orders=V.table(spark, sf_dir, "orders"))  # fmt: skip


@query("SET1 SNK4", f"""WITH {_FIND}, u AS (SELECT run_id, score, 0 AS pri FROM f UNION ALL SELECT run_id, score * 2, 1 FROM f WHERE run_id % 5 = 0)
SELECT run_id, round(arg_max(score, pri), 4) AS score FROM u GROUP BY run_id""")  # fmt: skip
def upsert_by_key(spark, sf_dir):
    """Later rows replace earlier ones of their key."""
    f = findings(spark, sf_dir).select("run_id", "score")
    late = f.filter(F.col("run_id") % 5 == 0).select("run_id", (F.col("score") * 2).alias("score"))
    both = f.withColumn("pri", F.lit(0)).unionByName(late.withColumn("pri", F.lit(1)))
    return both.groupBy("run_id").agg(F.round(F.max_by("score", "pri"), 4).alias("score"))


@query("SET2 SNK5", "SELECT s_suppkey AS key, s_name AS name, s_acctbal AS acctbal, NULL AS segment FROM supplier UNION ALL BY NAME SELECT c_custkey AS key, c_name AS name, NULL AS acctbal, c_mktsegment AS segment FROM customer")
def column_union(spark, sf_dir):
    s = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    c = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@query("SET3 STR12", f"""{D}, b AS (SELECT DISTINCT seq, frame // 24 AS batch, id FROM det), m AS (SELECT seq, max(batch) AS last FROM b GROUP BY seq)
SELECT seq, batch + 1 AS batch, id, 'missing' AS change FROM b JOIN m USING (seq) WHERE batch < last AND NOT EXISTS (SELECT 1 FROM b n WHERE n.seq = b.seq AND n.id = b.id AND n.batch = b.batch + 1)
UNION ALL SELECT seq, batch, id, 'new' FROM b WHERE NOT EXISTS (SELECT 1 FROM b n WHERE n.seq = b.seq AND n.id = b.id AND n.batch = b.batch - 1)""")  # fmt: skip
def new_and_missing_ids(spark, sf_dir):
    """Ids that one batch of frames has and the next lacks, or the other way round."""
    b = V.detections(spark, sf_dir).select("seq", F.floor(F.col("frame") / 24).alias("batch"), "id").distinct()
    by = Window.partitionBy("seq", "id").orderBy("batch")
    moved_ = b.withColumns({"before": F.lag("batch").over(by), "after": F.lead("batch").over(by), "last": F.max("batch").over(Window.partitionBy("seq"))})
    new = moved_.filter("before is null or before <> batch - 1").select("seq", "batch", "id", F.lit("new").alias("change"))
    gone = moved_.filter("batch < last and (after is null or after <> batch + 1)").select("seq", (F.col("batch") + 1).alias("batch"), "id", F.lit("missing").alias("change"))
    return gone.unionByName(new)


@query("SET5", """WITH t AS (SELECT l_orderkey AS k, list_distinct(list(l_partkey % 50)) AS a, list_distinct(list(l_suppkey % 50)) AS b FROM lineitem GROUP BY 1)
SELECT k, len(list_distinct(list_concat(a, b)))::BIGINT AS either, len(list_intersect(a, b))::BIGINT AS joint, len(list_filter(a, lambda x: NOT list_contains(b, x)))::BIGINT AS rest FROM t""")  # fmt: skip
def class_set_operations(spark, sf_dir):
    t = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set(F.col("l_partkey") % 50).alias("a"), F.collect_set(F.col("l_suppkey") % 50).alias("b"))
    size = lambda c: F.size(c).cast("bigint")
    return t.select("k", size(F.array_union("a", "b")).alias("either"), size(F.array_intersect("a", "b")).alias("joint"), size(F.array_except("a", "b")).alias("rest"))


@query("SET6", """WITH p AS (SELECT c_custkey AS id, c_nationkey * 100 + CAST(floor(c_acctbal / 500) AS BIGINT) AS name FROM customer)
SELECT o_orderkey, ref AS owner FROM orders JOIN p ON o_custkey = p.id JOIN (SELECT name, min(id) AS ref FROM p GROUP BY name) m USING (name)""")
def entity_dedup(spark, sf_dir):
    """Persons of one name become the least id; their children point there."""
    p = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") * 100 + F.floor(F.col("c_acctbal") / 500)).alias("name"))
    ref = p.withColumn("owner", F.min("id").over(Window.partitionBy("name"))).select(F.col("id").alias("o_custkey"), "owner")
    return V.table(spark, sf_dir, "orders").join(ref, "o_custkey").select("o_orderkey", "owner")
