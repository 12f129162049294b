"""Spatial, temporal, vector and dimension joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import views as V
from ..functions import boxes as B
from ..functions import text as T
from ..functions.boxes import box
from ..operators import joins as J
from ..operators.pairs import frame_pairs
from ..operators.together import together, triples
from ..registry import query

D = f"WITH {V.DET}"


def _neighbours(spark, sf_dir):
    """Detections moved so that boxes of a frame overlap: 15 apart, in rows of three."""
    d = V.detections(spark, sf_dir)
    return d.withColumns({"x": (F.col("id") % 7) * 15.0, "y": (F.col("id") % 3) * 10.0, "w": 40.0 + F.col("id") % 4})


_NB = f"""{V.DET}, nb AS (SELECT seq, frame, id, cls, score, (id % 7) * 15.0 AS x, (id % 3) * 10.0 AS y, 40.0 + id % 4 AS w, h FROM det),
p AS (SELECT a.seq, a.frame, a.id AS gid, b.id AS tid, a.cls AS ac, b.cls AS bc, a.score AS s, b.score AS bs, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, b.x AS bx, b.y AS by_, b.w AS bw, b.h AS bh,
  greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i FROM nb a JOIN nb b USING (seq, frame)),
q AS (SELECT *, i / (aw * ah + bw * bh - i) AS iou, (greatest(ax + aw, bx + bw) - least(ax, bx)) AS cw, (greatest(ay + ah, by_ + bh) - least(ay, by_)) AS ch,
  (ax + aw / 2 - bx - bw / 2) ** 2 + (ay + ah / 2 - by_ - bh / 2) ** 2 AS d2, 4 / pi() ** 2 * (atan(aw / ah) - atan(bw / bh)) ** 2 AS v FROM p)"""


@query("JN2", f"WITH {_NB} SELECT seq, frame, gid, tid, round(greatest(0, 1 - sqrt(d2) / 60), 6) AS sim FROM q WHERE gid < tid AND d2 < 3600")
def euclidean_pairs(spark, sf_dir):
    """Similarity of centres that are near. Equal boxes of a frame are compared once, their ids paired after that."""
    n = _neighbours(spark, sf_dir)
    at = ["seq", "frame", "x", "y", "w", "h"]
    held = n.groupBy(*at).agg(F.collect_list("id").alias("ids"))
    a, b = held.alias("a"), held.alias("b")
    sim = B.euclidean_similarity(box(alias="a"), box(alias="b"), 60.0)
    met = a.join(b, [F.col("a.seq") == F.col("b.seq"), F.col("a.frame") == F.col("b.frame")]).withColumn("sim", sim).filter("sim > 0")
    met = met.select("a.seq", "a.frame", F.col("a.ids").alias("p"), F.col("b.ids").alias("q"), F.round("sim", 6).alias("sim"))
    return met.select("seq", "frame", "q", "sim", F.explode("p").alias("gid")).select("seq", "frame", "gid", F.explode("q").alias("tid"), "sim").filter("gid < tid")


@query("JN4 JN5 JN6 RET10 RET12", f"""WITH {_NB} SELECT seq, frame, gid, tid, round(iou, 6) AS iou, round(iou - (cw * ch - (aw * ah + bw * bh - i)) / (cw * ch), 6) AS giou, round(iou - d2 / (cw ** 2 + ch ** 2), 6) AS diou,
  round(iou - d2 / (cw ** 2 + ch ** 2) - v * v / (1 - iou + v), 6) AS ciou, round(iou * greatest(0, least(ay + ah, by_ + bh) - greatest(ay, by_)) / ch, 6) AS hmiou, round(i / (aw * ah), 6) AS ioa FROM q WHERE gid < tid""")  # fmt: skip
def iou_family(spark, sf_dir):
    n = _neighbours(spark, sf_dir)
    a, b = n.alias("a"), n.alias("b")
    both = a.join(b, [F.col("a.seq") == F.col("b.seq"), F.col("a.frame") == F.col("b.frame"), F.col("a.id") < F.col("b.id")])
    x, y = box(alias="a"), box(alias="b")
    values = {"iou": B.iou, "giou": B.giou, "diou": B.diou, "ciou": B.ciou, "hmiou": B.hmiou, "ioa": B.ioa}
    return both.select("a.seq", "a.frame", F.col("a.id").alias("gid"), F.col("b.id").alias("tid"), *[F.round(f(x, y), 6).alias(k) for k, f in values.items()])


@query("JN7 JN8 JN9", f"""WITH {_NB} SELECT seq, frame, gid, tid, round(CASE WHEN ac <> bc THEN 1 ELSE 1 - iou END, 6) AS gated, round(1 - iou * bs, 6) AS fused, round(1 - bs * (1 + iou) / 2, 6) AS blended FROM q WHERE gid < tid AND i > 0""")
def association_costs(spark, sf_dir):
    """Class-gated, score-fused and appearance-blended costs of a pair. Equal boxes of a frame are compared once, their ids paired after that."""
    n = _neighbours(spark, sf_dir)
    at = ["seq", "frame", "x", "y", "w", "h"]
    held = lambda *more: n.groupBy(*at, *more).agg(F.collect_list(F.struct("id", "cls")).alias("ids"))
    a, b = held().alias("a"), held("score").alias("b")
    sim, score = B.iou(box(alias="a"), box(alias="b")), F.col("b.score")
    met = a.join(b, [F.col("a.seq") == F.col("b.seq"), F.col("a.frame") == F.col("b.frame")]).withColumn("sim", sim).filter("sim > 0")
    met = met.select("a.seq", "a.frame", F.col("a.ids").alias("p"), F.col("b.ids").alias("q"), F.round(1 - F.col("sim"), 6).alias("apart"),
                     F.round(1 - F.col("sim") * score, 6).alias("fused"), F.round(1 - score * (1 + F.col("sim")) / 2, 6).alias("blended"))
    costs = ["apart", "fused", "blended"]
    each = met.select("seq", "frame", "q", *costs, F.explode("p").alias("p")).select("seq", "frame", "p", *costs, F.explode("q").alias("q")).filter("p.id < q.id")
    return each.select("seq", "frame", F.col("p.id").alias("gid"), F.col("q.id").alias("tid"), F.when(F.col("p.cls") != F.col("q.cls"), 1.0).otherwise(F.col("apart")).alias("gated"), "fused", "blended")


@query("JN14 RET6", """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0)
SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 5) AS cos FROM q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id""")  # fmt: skip
def embedding_distance(spark, sf_dir):
    """Cosine of a stated query set (every fiftieth vector) against all vectors of its class."""
    e = V.table(spark, sf_dir, "embeddings")
    q = e.filter(F.col("vec_id") % 50 == 0)
    both = q.alias("q").join(e.alias("e"), (F.col("q.label") == F.col("e.label")) & (F.col("q.vec_id") != F.col("e.vec_id")))
    return both.select(F.col("q.vec_id").alias("query_id"), "e.vec_id", F.round(J.cosine(F.col("q.embedding"), F.col("e.embedding")), 5).alias("cos"))


@query("JN15", f"""WITH {_NB}, age AS (SELECT seq, frame, id, x, y, w, h, id % 5 AS age FROM nb),
dup AS (SELECT CASE WHEN a.age > b.age OR a.age = b.age AND a.id < b.id THEN b.id ELSE a.id END AS id, a.seq, a.frame FROM age a JOIN age b ON a.seq = b.seq AND a.frame = b.frame AND a.id < b.id
  JOIN q ON q.seq = a.seq AND q.frame = a.frame AND q.gid = a.id AND q.tid = b.id WHERE 1 - q.iou < 0.15)
SELECT seq, frame, id FROM nb WHERE NOT EXISTS (SELECT 1 FROM dup WHERE dup.seq = nb.seq AND dup.frame = nb.frame AND dup.id = nb.id)""")  # fmt: skip
def without_duplicate_tracks(spark, sf_dir):
    """Of two tracks that overlap almost wholly the younger goes. Equal boxes of a frame are compared once, by the oldest of them."""
    n = _neighbours(spark, sf_dir)
    return J.foremost(n, (-(F.col("id") % 5)).alias("younger"), 0.85)


@query("JN16", f"WITH {V.PAIRS} SELECT a.seq, a.frame, a.gid, b.id AS final FROM hit a JOIN (SELECT seq, frame, id AS tid, id % 1000 AS id FROM trk WHERE id < 100000) b USING (seq, frame, tid)")
def merged_matches(spark, sf_dir):
    """Two match tables composed: ground truth to track to stable id."""
    first = frame_pairs(V.ground_truth(spark, sf_dir), V.tracks(spark, sf_dir), least=0.5)
    second = V.tracks(spark, sf_dir).filter("id < 100000").select("seq", "frame", F.col("id").alias("tid"), (F.col("id") % 1000).alias("final"))
    return first.join(second, ["seq", "frame", "tid"]).select("seq", "frame", "gid", "final")


@query("JN17", f"WITH {_NB} SELECT seq, frame, gid AS id, round(max(i / (aw * ah)), 6) AS overlap FROM q WHERE gid <> tid AND bc IN (0, 1, 2) GROUP BY ALL")
def overlap_ratios(spark, sf_dir):
    """Largest share of a box that another of the relevant classes covers in its frame."""
    n = _neighbours(spark, sf_dir)
    out = frame_pairs(n, n.filter(F.col("cls").isin(0, 1, 2)), similarity=B.ioa).filter("gid <> tid")
    return out.groupBy("seq", "frame", F.col("gid").alias("id")).agg(F.round(F.max("sim"), 6).alias("overlap"))


@query("JN19", f"""WITH {_NB}, r AS (SELECT seq, frame, gid AS part, tid AS whole, round(i / (aw * ah), 6) AS share, row_number() OVER (PARTITION BY seq, frame, gid ORDER BY i / (aw * ah) DESC, tid) AS r FROM q WHERE ac = 1 AND bc = 2 AND i / (aw * ah) >= 0.3)
SELECT seq, frame, part, whole, share FROM r WHERE r = 1""")  # fmt: skip
def parts_to_objects(spark, sf_dir):
    n = _neighbours(spark, sf_dir)
    return J.best_overlap(n.filter("cls = 1"), n.filter("cls = 2"), ["seq", "frame"], 0.3).withColumn("share", F.round("share", 6))


@query("JN20", f"""WITH {_NB}, a AS (SELECT seq, frame, gid AS hand, tid AS person, d2, row_number() OVER (PARTITION BY seq, frame, gid ORDER BY d2, tid) AS r FROM q WHERE ac = 3 AND bc = 0 AND i > 0),
b AS (SELECT *, row_number() OVER (PARTITION BY seq, frame, person ORDER BY d2, hand) AS k FROM a WHERE r = 1) SELECT seq, frame, hand, person FROM b WHERE k <= 2""")  # fmt: skip
def hands_to_persons(spark, sf_dir):
    """Each hand goes to the nearest person that it overlaps; a person keeps the two nearest."""
    n = _neighbours(spark, sf_dir)
    x, y = box(alias="a"), box(alias="b")
    both = n.filter("cls = 3").alias("a").join(n.filter("cls = 0").alias("b"), [F.col("a.seq") == F.col("b.seq"), F.col("a.frame") == F.col("b.frame"), B.intersection(x, y) > 0])
    both = both.select("a.seq", "a.frame", F.col("a.id").alias("hand"), F.col("b.id").alias("person"), B.centre_gap2(x, y).alias("d2"))
    one = both.withColumn("r", F.row_number().over(Window.partitionBy("seq", "frame", "hand").orderBy("d2", "person"))).filter("r = 1")
    return one.withColumn("k", F.row_number().over(Window.partitionBy("seq", "frame", "person").orderBy("d2", "hand"))).filter("k <= 2").select("seq", "frame", "hand", "person")


@query("JN22 STR23", f"""WITH {_NB}, c AS (SELECT *, sqrt(d2) AS d, (aw + bw) / 2 AS unit FROM q WHERE ac = 0 AND bc IN (1, 2))
SELECT gid, tid, min(frame) AS first, max(frame) AS last, count(*) AS frames FROM c WHERE d BETWEEN 0.2 * unit AND 1.2 * unit GROUP BY ALL HAVING max(frame) - min(frame) >= 24""")  # fmt: skip
def close_proximity(spark, sf_dir):
    """Pairs whose centre distance lies in a band of their size, from first to last seen for long enough."""
    n = _neighbours(spark, sf_dir)

    def gap(a, b):
        unit, dx, dy = (a[2] + b[2]) / 2, (a[0] + (a[0] + a[2])) / 2 - (b[0] + (b[0] + b[2])) / 2, (a[1] + (a[1] + a[3])) / 2 - (b[1] + (b[1] + b[3])) / 2
        d = np.sqrt(dx * dx + dy * dy)
        return np.where((d >= 0.2 * unit) & (d <= 1.2 * unit), d, np.nan)

    # An id belongs to one sequence.
    return together(n.filter("cls = 0"), n.filter("cls in (1, 2)"), gap).filter("last - first >= 24").select("gid", "tid", "first", "last", "frames")


@query("JN23", f"{D} SELECT a.seq, a.id AS a, b.id AS b, c.id AS c, count(*) AS frames FROM det a JOIN det b USING (seq, frame) JOIN det c USING (seq, frame) WHERE a.cls = 0 AND b.cls = 1 AND c.cls = 2 GROUP BY ALL")
def co_occurrence(spark, sf_dir):
    """Ids of three required classes that share a frame: blocks of ids meet, and no row is made for a meeting."""
    d = V.detections(spark, sf_dir)
    return triples(tuple(d.filter(F.col("cls") == cls) for cls in (0, 1, 2)))


@query("JN24 STR24", f"""WITH {_NB}, d AS (SELECT seq, frame, gid, tid, least(abs(ax - (bx + bw)), abs(ax + aw - bx), abs(ay + ah / 2 - (by_ + bh / 2))) AS gap FROM q WHERE gid < tid)
SELECT seq, gid, tid, round(min(gap), 6) AS gap, count(*) AS frames FROM d WHERE gap < 12 GROUP BY ALL""")  # fmt: skip
def lane_gaps(spark, sf_dir):
    """Least edge distance of each pair over the frames in which it is short."""
    n = _neighbours(spark, sf_dir)

    def gap(a, b):
        d = np.minimum(np.minimum(np.abs(a[0] - (b[0] + b[2])), np.abs(a[0] + a[2] - b[0])), np.abs((a[1] + (a[1] + a[3])) / 2 - (b[1] + (b[1] + b[3])) / 2))
        return np.where(d < 12, d, np.nan)

    return together(n, n, gap, ordered=True).select("seq", "gid", "tid", F.round("least", 6).alias("gap"), "frames")


@query("JN25", f"""WITH {_NB}, h AS (SELECT seq, frame, gid, tid, sqrt(d2) AS d, row_number() OVER (PARTITION BY seq, frame, gid ORDER BY d2, tid) AS r FROM q WHERE ac = 4 AND bc = 0)
SELECT seq, frame, gid AS hazard, tid AS person, round(d, 6) AS distance FROM h WHERE r = 1""")  # fmt: skip
def nearest_person(spark, sf_dir):
    n = _neighbours(spark, sf_dir)
    out = frame_pairs(n.filter("cls = 4"), n.filter("cls = 0"), similarity=lambda a, b: F.sqrt(B.centre_gap2(a, b)))
    best = F.row_number().over(Window.partitionBy("seq", "frame", "gid").orderBy("sim", "tid"))
    return out.withColumn("r", best).filter("r = 1").select("seq", "frame", F.col("gid").alias("hazard"), F.col("tid").alias("person"), F.round("sim", 6).alias("distance"))


_CENTROIDS = """c AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY ALL) GROUP BY label)"""


def centroids(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))


@query("JN26 JN27", f"""WITH {_CENTROIDS}, s AS (SELECT vec_id, c.label, list_dot_product(CAST(embedding AS DOUBLE[]), v) AS s FROM embeddings, c)
SELECT vec_id, max(CASE WHEN label < 8 THEN round(s, 5) END) AS positive, coalesce(max(CASE WHEN label >= 8 THEN s END) > max(CASE WHEN label < 8 THEN s END), false) AS overridden FROM s WHERE s > 0.02 GROUP BY vec_id""")  # fmt: skip
def custom_object_vectors(spark, sf_dir):
    """Best reference above a threshold per vector; a better negative reference (labels 8, 9) overrides it."""
    found = J.match_vectors(V.table(spark, sf_dir, "embeddings"), centroids(spark, sf_dir), "embedding", 0.02)
    best = found.groupBy("a.vec_id").agg(F.max(F.when(F.col("b.label") < 8, F.col("score"))).alias("pos"), F.max(F.when(F.col("b.label") >= 8, F.col("score"))).alias("neg"))
    return best.select("vec_id", F.round("pos", 5).alias("positive"), F.coalesce(F.col("neg") > F.col("pos"), F.lit(False)).alias("overridden"))


@query("JN28", """WITH l AS (SELECT DISTINCT p_name AS plate FROM part WHERE p_partkey % 97 = 0), s AS (SELECT p_partkey, plate, 1 - levenshtein(p_name, plate) / greatest(length(p_name), length(plate), 1) AS s FROM part, l)
SELECT p_partkey, plate, CASE WHEN s >= 0.9 THEN 'high' ELSE 'medium' END AS band FROM s WHERE s >= 0.6""")  # fmt: skip
def plate_match(spark, sf_dir):
    """Whole names against a watch list (the names of every 97th part, the stated list), in bands of similarity."""
    p = V.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    watch = p.filter(F.col("p_partkey") % 97 == 0).select(F.col("p_name").alias("plate")).distinct()
    s = T.plate_similarity(F.col("p_name"), F.col("plate"))
    return J.against(p, watch, s >= 0.6).select("p_partkey", "plate", F.when(s >= 0.9, "high").otherwise("medium").alias("band"))


def _typed(spark, sf_dir, kind):
    e = V.events(spark, sf_dir).filter(F.col("event_type") == kind)
    return e.groupBy("user_id", "ms").agg(F.min("event_id").alias("event_id"))


_TYPED = V.EV + """, er AS (SELECT user_id, ms, min(event_id) AS event_id FROM ev WHERE event_type = 'error' GROUP BY ALL), vw AS (SELECT user_id, ms, min(event_id) AS view_id FROM ev WHERE event_type = 'view' GROUP BY ALL)"""


@query("JN31", f"WITH {_TYPED} SELECT er.user_id, er.ms, er.event_id, vw.view_id, vw.ms AS matched_at FROM er ASOF LEFT JOIN vw ON er.user_id = vw.user_id AND er.ms >= vw.ms")
def asof_latest(spark, sf_dir):
    """Each error with the user's latest view at or before it."""
    views = _typed(spark, sf_dir, "view").withColumnRenamed("event_id", "view_id")
    return J.asof(_typed(spark, sf_dir, "error"), views, ["user_id"], "ms", "view_id")


@query("JN31 JN32", f"""WITH {_TYPED}, c AS (SELECT er.user_id, er.ms, er.event_id, vw.view_id, vw.ms AS vt, row_number() OVER (PARTITION BY er.event_id ORDER BY abs(vw.ms - er.ms), vw.ms) AS r FROM er LEFT JOIN vw ON er.user_id = vw.user_id AND abs(vw.ms - er.ms) <= 7200000)
SELECT user_id, ms, event_id, view_id, vt AS matched_at FROM c WHERE r = 1""")  # fmt: skip
def asof_nearest(spark, sf_dir):
    """Each error with the view nearest to it within two hours, if any; of two as near the earlier."""
    views = _typed(spark, sf_dir, "view").withColumnRenamed("event_id", "view_id")
    return J.asof(_typed(spark, sf_dir, "error"), views, ["user_id"], "ms", "view_id", tolerance=7200000, nearest=True)


@query("JN33 STR44", f"""WITH {V.EV}, t AS (SELECT event_id, user_id % 8 AS door, ms FROM ev WHERE event_type = 'error'), p AS (SELECT user_id % 8 AS door, ms FROM ev WHERE event_type = 'click')
SELECT t.event_id, count(p.ms) AS present, count(p.ms) = 0 AS alarm FROM t LEFT JOIN p ON t.door = p.door AND p.ms BETWEEN t.ms - 600000 AND t.ms + 300000 GROUP BY t.event_id""")  # fmt: skip
def trigger_presence(spark, sf_dir):
    """A trigger without presence from 10 minutes before to 5 after raises an alarm."""
    e = V.events(spark, sf_dir).withColumn("door", F.col("user_id") % 8)
    t = e.filter("event_type = 'error'").select("event_id", "door", "ms")
    p = e.filter("event_type = 'click'").select("door", "ms")
    met = J.interval(t, p, ["door"], "ms", 600000, 300000).groupBy(F.col("a.event_id").alias("event_id")).agg(F.count(F.lit(1)).alias("n"))
    out = t.join(met, "event_id", "left").select("event_id", F.coalesce("n", F.lit(0)).cast("long").alias("present"))
    return out.withColumn("alarm", F.col("present") == 0)


@query("JN34", """SELECT n_name, r_name, count(DISTINCT c_custkey) AS customers, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def dimension_stitching(spark, sf_dir):
    n, r, c = (V.table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    both = n.join(r, n.n_regionkey == r.r_regionkey).join(c, n.n_nationkey == c.c_nationkey, "left")
    return both.groupBy("n_name", "r_name").agg(F.countDistinct("c_custkey").alias("customers"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"))


@query("JN35", """WITH g AS (SELECT s_suppkey AS grp, unnest([s_suppkey * 10, s_suppkey * 10 + 1, s_suppkey * 10 + 3]) AS member FROM supplier) SELECT grp, count(o_orderkey) AS orders, count(DISTINCT c_custkey) AS members FROM g JOIN customer ON c_custkey = member LEFT JOIN orders ON o_custkey = c_custkey GROUP BY grp""")
def group_members(spark, sf_dir):
    """Groups exploded to members, joined to their entities."""
    s, c, o = (V.table(spark, sf_dir, t) for t in ("supplier", "customer", "orders"))
    k = F.col("s_suppkey")
    g = s.select(k.alias("grp"), F.explode(F.array(k * 10, k * 10 + 1, k * 10 + 3)).alias("member"))
    return g.join(c, g.member == c.c_custkey).join(o, c.c_custkey == o.o_custkey, "left").groupBy("grp").agg(F.count("o_orderkey").alias("orders"), F.countDistinct("c_custkey").alias("members"))


@query("JN36 JN37", """WITH t AS (SELECT l_orderkey AS k, round(avg(l_quantity), 4) AS ms FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1), r AS (SELECT DISTINCT o_orderpriority AS p, length(o_orderpriority) AS ms FROM orders)
SELECT o_orderkey, coalesce(t.ms, CASE WHEN o_orderstatus = 'O' THEN r.ms END) AS ms_per_frame FROM orders LEFT JOIN t ON k = o_orderkey LEFT JOIN r ON p = o_orderpriority""")  # fmt: skip
def timing_coalesce(spark, sf_dir):
    """Measured timing, else the reference of its kind, else nothing."""
    o = V.table(spark, sf_dir, "orders")
    t = V.table(spark, sf_dir, "lineitem").filter(F.col("l_orderkey") % 3 == 0).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.avg("l_quantity"), 4).alias("ms"))
    r = o.select("o_orderpriority").distinct().select("o_orderpriority", F.length("o_orderpriority").alias("ref"))
    both = o.join(t, "o_orderkey", "left").join(r, "o_orderpriority", "left")
    return both.select("o_orderkey", F.coalesce("ms", F.when(F.col("o_orderstatus") == "O", F.col("ref").cast("double"))).alias("ms_per_frame"))


@query("JN38", "SELECT e.event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, count(v.user_id) AS verified FROM events e LEFT JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 90) v ON e.user_id = v.user_id GROUP BY ALL")
def verified_attributes(spark, sf_dir):
    return spark.sql("""SELECT e.event_type, cast(get_json_object(props, '$.k') AS bigint) AS k, count(*) AS n, count(v.user_id) AS verified FROM {events} e
      LEFT JOIN (SELECT DISTINCT user_id FROM {events} WHERE event_type = 'purchase' AND value > 90) v ON e.user_id = v.user_id GROUP BY ALL""", events=V.table(spark, sf_dir, "events"))  # fmt: skip


@query("JN3", f"WITH {V.DET}, m AS (SELECT seq, frame, id, id % 7 * 10 AS s, 25 + id % 4 AS n FROM det), o AS (SELECT a.seq, a.frame, a.id AS gid, b.id AS tid, greatest(0, least(a.s + a.n, b.s + b.n) - greatest(a.s, b.s)) AS i, a.n + b.n AS t FROM m a JOIN m b ON a.seq = b.seq AND a.frame = b.frame AND a.id < b.id) SELECT seq, frame, gid, tid, round(2 * i / (2 * t - 2 * i), 6) AS iou FROM o")
def mask_pairs(spark, sf_dir):
    """IoU of run-length masks in all frames; each mask here is two runs of one length, a thousand pixels apart."""
    boxes = V.detections(spark, sf_dir)
    start, n = F.col("id") % 7 * 10, 25 + F.col("id") % 4
    run = lambda s: F.struct(s.alias("start"), n.alias("length"))
    m = boxes.select("seq", "frame", "id", F.array(run(start), run(start + 1000)).alias("mask"))
    pairs = J.mask_pairs(m, ["seq", "frame"], "id", "mask", lambda a, b: F.round(J.mask_iou(a, b), 6))
    return pairs.withColumnsRenamed({"a": "gid", "b": "tid"})
