"""Counts, statistics, histograms and roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import views as V
from ..operators import aggregates as A
from ..operators.pairs import frame_spine
from ..registry import query
from .filters import _FIND, findings

D = f"WITH {V.DET}"


def one():
    """Counts rows."""
    return F.count(F.lit(1))



def _d(spark, sf_dir):
    return V.detections(spark, sf_dir)


@query("AGG1", f"{D} SELECT DISTINCT seq, cls FROM det WHERE score >= 0.5")
def distinct_values(spark, sf_dir):
    return _d(spark, sf_dir).filter("score >= 0.5").select("seq", "cls").distinct()


@query("AGG2", f"""WITH {V.EV}, t AS (SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY ALL), m AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM t),
k AS (SELECT DISTINCT event_type FROM ev UNION ALL SELECT 'none') SELECT k.event_type, count(user_id) AS objects FROM k LEFT JOIN m ON m.event_type = k.event_type AND r = 1 GROUP BY ALL""")  # fmt: skip
def objects_per_class(spark, sf_dir):
    """Each id counts for its most frequent class; classes without ids count zero."""
    e = V.table(spark, sf_dir, "events")
    n = e.groupBy("user_id", "event_type").agg(one().alias("n"))
    modal = n.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type"))).filter("r = 1")
    kinds = e.select("event_type").distinct().unionByName(spark.createDataFrame([("none",)], "event_type string"))
    return frame_spine(kinds, modal.groupBy("event_type").agg(one().alias("objects")), ["event_type"], "objects")


@query("AGG3", f"{D} SELECT seq, frame, count(*) FILTER (cls = 0) AS c0, count(*) FILTER (cls = 1) AS c1, count(*) FILTER (cls = 2) AS c2 FROM det GROUP BY ALL")
def frame_class_counts(spark, sf_dir):
    out = _d(spark, sf_dir).groupBy("seq", "frame").pivot("cls", [0, 1, 2]).agg(one())
    return out.select("seq", "frame", *[F.coalesce(F.col(str(c)), F.lit(0)).alias(f"c{c}") for c in (0, 1, 2)])


@query("AGG4 STR45", f"""{D}, s AS (SELECT seq, frame FROM (SELECT DISTINCT seq FROM det), (SELECT unnest(range(1, last + 1)) AS frame FROM (SELECT max(frame) AS last FROM det))), c AS (SELECT seq, frame, count(*) AS n FROM det WHERE cls <= 2 GROUP BY ALL),
f AS (SELECT seq, frame, coalesce(n, 0) AS n, frame // 60 AS period FROM s LEFT JOIN c USING (seq, frame)), nw AS (SELECT seq, frame // 60 AS period, count(*) AS fresh FROM (SELECT seq, id, min(frame) AS frame FROM det WHERE cls <= 2 GROUP BY ALL) GROUP BY ALL)
SELECT seq, period, min(n) AS lo, max(n) AS hi, round(avg(n), 6) AS mean, arg_max(n, frame) AS latest, coalesce(max(fresh), 0) AS fresh FROM f LEFT JOIN nw USING (seq, period) GROUP BY ALL""")  # fmt: skip
def object_variable(spark, sf_dir):
    """Per period: least, most, mean and latest count of a frame (empty frames count zero), and ids seen for the first time."""
    d = _d(spark, sf_dir).filter("cls <= 2")
    spine = V.every_frame(_d(spark, sf_dir))
    n = frame_spine(spine, d.groupBy("seq", "frame").agg(one().alias("n")), ["seq", "frame"], "n").withColumn("period", F.floor(F.col("frame") / 60))
    fresh = d.groupBy("seq", "id").agg(F.min("frame").alias("frame")).groupBy("seq", F.floor(F.col("frame") / 60).alias("period")).agg(one().alias("fresh"))
    stat = n.groupBy("seq", "period").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.round(F.avg("n"), 6).alias("mean"), F.max_by("n", "frame").alias("latest"))
    return frame_spine(stat, fresh, ["seq", "period"], "fresh")


@query("AGG5 AGG11 STR22", "SELECT event_type, epoch_us(ts) // 1000 // 3600000 * 3600000 AS period, count(*) AS n FROM events GROUP BY ALL")
def event_variable(spark, sf_dir):
    return V.events(spark, sf_dir).groupBy("event_type", (F.floor(F.col("ms") / 3600000) * 3600000).alias("period")).agg(one().alias("n"))


@query("AGG6", f"{D}, p AS (SELECT DISTINCT seq, frame // 60 AS period, id FROM det) SELECT seq, period, count(*) AS fresh FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.seq = p.seq AND q.id = p.id AND q.period = p.period - 1) GROUP BY ALL")
def period_newcomers(spark, sf_dir):
    """Ids of a period that the one before didn't have."""
    p = _d(spark, sf_dir).select("seq", F.floor(F.col("frame") / 60).alias("period"), "id").distinct()
    before = p.select("seq", (F.col("period") + 1).alias("period"), "id")
    return p.join(before, ["seq", "period", "id"], "left_anti").groupBy("seq", "period").agg(one().alias("fresh"))


@query("AGG7", f"{D} SELECT seq, cell, count(*) AS n FROM det GROUP BY ALL")
def heatmap_samples(spark, sf_dir):
    return _d(spark, sf_dir).groupBy("seq", "cell").agg(one().alias("n"))


@query("AGG8 WIN10", f"{D}, s AS (SELECT seq, id, cell, frame, lead(frame) OVER (PARTITION BY seq, id ORDER BY frame) AS nxt FROM det) SELECT seq, cell, sum((coalesce(nxt, frame) - frame) * 3600000)::BIGINT AS dwell FROM s GROUP BY ALL")
def heatmap_dwell(spark, sf_dir):
    """Time that ids stay on a cell, until they show up elsewhere."""
    s = _d(spark, sf_dir).withColumn("nxt", F.lead("frame").over(Window.partitionBy("seq", "id").orderBy("frame")))
    return s.groupBy("seq", "cell").agg(F.sum((F.coalesce("nxt", "frame") - F.col("frame")) * 3600000).alias("dwell"))


@query("AGG9", f"{D}, p AS (SELECT seq, id, frame // 120 AS part, string_agg(CAST(cell // 256 AS VARCHAR), '>' ORDER BY frame) AS path FROM det GROUP BY ALL) SELECT path, count(*) AS n FROM p GROUP BY ALL")
def traffic_paths(spark, sf_dir):
    """Ordered zone sequences of ids and how many follow each."""
    d = _d(spark, sf_dir)
    steps = F.transform(F.array_sort(F.collect_list(F.struct("frame", F.floor(F.col("cell") / 256).cast("string").alias("z")))), lambda s: s["z"])
    return d.groupBy("seq", "id", F.floor(F.col("frame") / 120).alias("part")).agg(F.array_join(steps, ">").alias("path")).groupBy("path").agg(one().alias("n"))


_IO = "CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END"


@query("AGG10", f"SELECT user_id % 8 AS seq, sum(greatest({_IO}, 0))::BIGINT AS ins, sum(greatest(-({_IO}), 0))::BIGINT AS outs FROM events GROUP BY ALL")
def in_out_counts(spark, sf_dir):
    v = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    return V.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).alias("seq")).agg(F.sum(F.greatest(v, F.lit(0))).alias("ins"), F.sum(F.greatest(-v, F.lit(0))).alias("outs"))


@query("AGG12 STR15", f"SELECT user_id, sign(sum({_IO}))::BIGINT AS net, min(epoch_us(ts) // 1000) AS first, max(epoch_us(ts) // 1000) AS last FROM events GROUP BY user_id HAVING sum({_IO}) <> 0")
def net_crossings(spark, sf_dir):
    """Direction of an entity's net crossings; as many in as out gives none."""
    v = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    out = V.events(spark, sf_dir).groupBy("user_id").agg(F.sum(v).alias("s"), F.min("ms").alias("first"), F.max("ms").alias("last"))
    return out.filter("s <> 0").select("user_id", F.signum("s").cast("long").alias("net"), "first", "last")


@query("AGG13 STR22", f"{D}, i AS (SELECT seq, frame // 8 AS batch, id, min(cls) AS cls FROM det GROUP BY ALL HAVING count(*) >= 4) SELECT seq, batch, cls, count(*) AS n FROM i GROUP BY ALL")
def region_count(spark, sf_dir):
    """Ids present in at least half of a batch's frames, by class."""
    i = _d(spark, sf_dir).groupBy("seq", F.floor(F.col("frame") / 8).alias("batch"), "id").agg(F.min("cls").alias("cls"), one().alias("n")).filter("n >= 4")
    return i.groupBy("seq", "batch", "cls").agg(one().alias("n"))


@query("AGG14", f"{D} SELECT seq, cell // 256 AS zone, frame, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM det GROUP BY ALL")
def zone_occupants(spark, sf_dir):
    ids = F.array_join(F.transform(F.array_sort(F.collect_set("id")), lambda i: i.cast("string")), ",")
    return _d(spark, sf_dir).groupBy("seq", F.floor(F.col("cell") / 256).alias("zone"), "frame").agg(ids.alias("ids"))


@query("AGG15 STR46", f"""{D}, m AS (SELECT seq, frame // 24 AS win, cls, count(DISTINCT id) AS ids FROM det GROUP BY ALL), s AS (SELECT seq, frame // 24 AS win, cls, max(n) AS peak FROM (SELECT seq, frame, cls, count(*) AS n FROM det GROUP BY ALL) GROUP BY ALL)
SELECT * FROM m JOIN s USING (seq, win, cls)""")  # fmt: skip
def occupancy_timeline(spark, sf_dir):
    """Distinct ids and most at once, per window and class."""
    d = _d(spark, sf_dir).withColumn("win", F.floor(F.col("frame") / 24))
    peak = d.groupBy("seq", "win", "cls", "frame").agg(one().alias("n")).groupBy("seq", "win", "cls").agg(F.max("n").alias("peak"))
    return d.groupBy("seq", "win", "cls").agg(F.countDistinct("id").alias("ids")).join(peak, ["seq", "win", "cls"])


@query("AGG16", f"{D}, c AS (SELECT seq, frame // 24 AS win, cell, max(score) AS level FROM det GROUP BY ALL) SELECT seq, win, (cell // 32 // 8) * 4 + (cell % 32) // 8 AS block, max(level) AS level, count(*) AS cells FROM c GROUP BY ALL")
def motion_rollup(spark, sf_dir):
    """Largest level of each 32 by 32 cell in a window, then of each of 4 by 4 blocks."""
    c = _d(spark, sf_dir).groupBy("seq", F.floor(F.col("frame") / 24).alias("win"), "cell").agg(F.max("score").alias("level"))
    block = F.floor(F.floor(F.col("cell") / 32) / 8) * 4 + F.floor(F.col("cell") % 32 / 8)
    return c.groupBy("seq", "win", block.alias("block")).agg(F.max("level").alias("level"), one().alias("cells"))


@query("AGG17", f"{D} SELECT seq, quantile_disc(cell, 0.95) AS p95, max(cell) AS most FROM det GROUP BY seq")
def motion_index(spark, sf_dir):
    return _d(spark, sf_dir).groupBy("seq").agg(F.expr("percentile_disc(0.95) within group (order by cell)").alias("p95"), F.max("cell").alias("most"))


@query("AGG18", """WITH b AS (SELECT l_returnflag AS flag, CAST(floor(l_discount * 1000) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY flag ORDER BY bin) AS s, sum(n) OVER (PARTITION BY flag) AS t FROM b)
SELECT flag, min(bin) AS bin FROM c WHERE s >= 0.9 * t GROUP BY flag""")  # fmt: skip
def histogram_percentile(spark, sf_dir):
    return A.histogram_percentile(V.table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag"), ["flag"], F.floor(F.col("l_discount") * 1000), 0.9)


@query("AGG19 AGG20", f"""{D}, h AS (SELECT cls, count(*) AS n FROM det GROUP BY cls), g AS (SELECT cell // 64 AS z, count(*) AS n FROM det GROUP BY ALL), t AS (SELECT count(*) AS n FROM det)
SELECT seq, frame, round(max(1 - h.n / t.n + 1 - g.n / t.n), 6) AS score FROM det JOIN h USING (cls) JOIN g ON g.z = cell // 64, t GROUP BY ALL""")  # fmt: skip
def rarity_score(spark, sf_dir):
    """An image scores by its rarest detection; class and place are the rarer the fewer detections have them."""
    d = _d(spark, sf_dir).withColumn("z", F.floor(F.col("cell") / 64))
    total = d.agg(one().alias("t"))
    h, g = d.groupBy("cls").agg(one().alias("of_class")), d.groupBy("z").agg(one().alias("of_zone"))
    both = d.join(F.broadcast(h), "cls").join(F.broadcast(g), "z").join(F.broadcast(total))  # a row per class, per zone (16), and one
    return both.groupBy("seq", "frame").agg(F.round(F.max(2 - F.col("of_class") / F.col("t") - F.col("of_zone") / F.col("t")), 6).alias("score"))


@query("AGG21 AGG22", f"{D} SELECT seq, id, round(avg(score), 8) AS mean, max(score) AS most, median(cell) AS mid_cell, median(x) AS mid_x FROM det GROUP BY ALL")
def running_confidence(spark, sf_dir):
    return _d(spark, sf_dir).groupBy("seq", "id").agg(F.round(F.avg("score"), 8).alias("mean"), F.max("score").alias("most"), F.median("cell").alias("mid_cell"), F.median("x").alias("mid_x"))


@query("AGG23", f"{D} SELECT seq, id, CASE WHEN count(DISTINCT cell) > 60 THEN 32 ELSE greatest(max(cell // 32) - min(cell // 32), max(cell % 32) - min(cell % 32)) END::BIGINT AS span FROM det GROUP BY ALL")
def route_span(spark, sf_dir):
    row, col = F.floor(F.col("cell") / 32), F.col("cell") % 32
    wide = F.greatest(F.max(row) - F.min(row), F.max(col) - F.min(col))
    return _d(spark, sf_dir).groupBy("seq", "id").agg(F.when(F.countDistinct("cell") > 60, 32).otherwise(wide).cast("long").alias("span"))


@query("AGG24", f"{D} SELECT seq, cls, median(score) AS mid, round(stddev_pop(cell), 5) AS spread, round(avg(x), 6) AS cx FROM det GROUP BY ALL")
def hazard_statistics(spark, sf_dir):
    return _d(spark, sf_dir).groupBy("seq", "cls").agg(F.median("score").alias("mid"), F.round(F.stddev_pop("cell"), 5).alias("spread"), F.round(F.avg("x"), 6).alias("cx"))


@query("AGG25", "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.label, a.vec_id, sum(1 - list_dot_product(a.v, b.v)) AS s FROM e a JOIN e b ON a.label = b.label GROUP BY ALL) SELECT label, arg_min(vec_id, s) AS medoid FROM s GROUP BY label")
def medoid(spark, sf_dir):
    """Member of each class with the least summed distance to the others. The sum needs no pairs: it is n minus the dot product with the class's sum."""
    e = V.table(spark, sf_dir, "embeddings")
    total = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.sum(F.col("x").cast("double")).alias("t"))
    parts = e.select("label", "vec_id", F.posexplode("embedding").alias("i", "x")).join(total, ["label", "i"])
    near = parts.groupBy("label", "vec_id").agg(F.sum(F.col("x") * F.col("t")).alias("s"))
    return near.groupBy("label").agg(F.max_by("vec_id", "s").alias("medoid"))


@query("AGG26", f"""{D}, sp AS (SELECT seq, frame, coalesce(n, 0) AS n FROM (SELECT seq, unnest(range(1, last + 1)) AS frame FROM (SELECT DISTINCT seq FROM det), (SELECT max(frame) AS last FROM det)) LEFT JOIN (SELECT seq, frame, count(*) AS n FROM det GROUP BY ALL) USING (seq, frame)),
r AS (SELECT seq, n, row_number() OVER (PARTITION BY seq ORDER BY n) - 1 AS r FROM sp), den AS (SELECT seq, round(avg(n), 6) AS mean, max(n) AS top, max(CASE WHEN r = round_even(0.95 * ((SELECT max(frame) FROM det) - 1), 0) THEN n END) AS p95 FROM r GROUP BY seq),
l AS (SELECT seq, id, count(*) AS n FROM det GROUP BY ALL), ln AS (SELECT seq, count(*) AS tracks, round(avg(n), 6) AS length_mean, median(n) AS length_median, max(n) AS length_max FROM l GROUP BY seq),
v AS (SELECT seq, count(*) AS boxes, count(*) FILTER (cls IN (0, 1)) AS vehicles FROM det GROUP BY seq) SELECT * FROM den JOIN ln USING (seq) JOIN v USING (seq)""")  # fmt: skip
def dataset_statistics(spark, sf_dir):
    """Density (frames without boxes count), track lengths and class counts of each sequence."""
    d = _d(spark, sf_dir)
    spine = V.every_frame(d)
    n = frame_spine(spine, d.groupBy("seq", "frame").agg(one().alias("n")), ["seq", "frame"], "n")
    density = n.groupBy("seq").agg(F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("top")).join(A.nearest_rank(n, ["seq"], "n", 0.95, "p95"), "seq")
    length = d.groupBy("seq", "id").agg(one().alias("n")).groupBy("seq").agg(one().alias("tracks"), F.round(F.avg("n"), 6).alias("length_mean"), F.median("n").alias("length_median"), F.max("n").alias("length_max"))
    boxes = d.groupBy("seq").agg(one().alias("boxes"), F.count_if(F.col("cls").isin(0, 1)).alias("vehicles"))
    return density.join(length, "seq").join(boxes, "seq")


@query("AGG27", f"{D}, s AS (SELECT seq, count(*) AS n, count(DISTINCT id) AS tracks FROM det GROUP BY seq) SELECT sum(n)::BIGINT AS boxes, round(avg(n), 6) AS mean, min(n) AS lo, max(n) AS hi, arg_max(seq, n) AS densest, arg_min(seq, n) AS sparsest, sum(tracks)::BIGINT AS tracks FROM s")
def dataset_summary(spark, sf_dir):
    s = _d(spark, sf_dir).groupBy("seq").agg(one().alias("n"), F.countDistinct("id").alias("tracks"))
    return s.agg(F.sum("n").alias("boxes"), F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max_by("seq", "n").alias("densest"), F.min_by("seq", "n").alias("sparsest"), F.sum("tracks").alias("tracks"))


@query("AGG28 AGG29", "WITH r AS (SELECT l_suppkey AS k, l_linenumber AS rep, sum(l_quantity) AS s, count(*) AS frames FROM lineitem GROUP BY ALL) SELECT k, round(min(s * 1000 / frames), 4) AS best_ms, round(sum(s) * 1000 / sum(frames), 4) AS total_ms FROM r GROUP BY k")
def speed_reference(spark, sf_dir):
    """Best repeat and overall time per frame."""
    r = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), "l_linenumber").agg(F.sum("l_quantity").alias("s"), one().alias("frames"))
    return r.groupBy("k").agg(F.round(F.min(F.col("s") * 1000 / F.col("frames")), 4).alias("best_ms"), F.round(F.sum("s") * 1000 / F.sum("frames"), 4).alias("total_ms"))


@query("AGG30 WIN1", f"WITH {_FIND} SELECT benchmark, tracker, round(max(score), 4) AS best, round(min(score), 4) AS least, arg_max(run_id, score) AS run_id FROM f GROUP BY ALL")
def best_metric(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("benchmark", "tracker").agg(F.round(F.max("score"), 4).alias("best"), F.round(F.min("score"), 4).alias("least"), F.max_by("run_id", "score").alias("run_id"))


@query("AGG31", "SELECT 'priority' AS key, count(DISTINCT o_orderpriority) AS n FROM orders UNION ALL SELECT 'status', count(DISTINCT o_orderstatus) FROM orders")
def varied_config_keys(spark, sf_dir):
    """Keys of a configuration map that take more than one value."""
    c = F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus"), F.lit("fixed"), F.lit("x"))
    each = V.table(spark, sf_dir, "orders").select(F.explode(c).alias("key", "value"))
    return each.groupBy("key").agg(F.countDistinct("value").alias("n")).filter("n > 1")


@query("AGG32 AGG33", "SELECT event_type, user_id % 5 AS camera, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 350")
def alert_value_counts(spark, sf_dir):
    return V.table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 5).alias("camera")).agg(one().alias("n")).filter("n > 350")


@query("AGG33", "SELECT c_nationkey, c_mktsegment, count(*) AS n, count(DISTINCT floor(c_acctbal)) AS kinds FROM customer GROUP BY ALL HAVING count(*) > 8")
def duplicates_having(spark, sf_dir):
    return V.table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(one().alias("n"), F.countDistinct(F.floor("c_acctbal")).alias("kinds")).filter("n > 8")


@query("RET13", f"{D}, v AS (SELECT cls, 1 / count(*) AS inverse FROM det GROUP BY cls) SELECT seq, frame, round(sum(inverse), 8) AS weight FROM det JOIN v USING (cls) GROUP BY ALL")
def sampling_weights(spark, sf_dir):
    """Image weights as sums of inverse class frequencies."""
    d = _d(spark, sf_dir)
    w = d.groupBy("cls").agg((1 / one()).alias("inverse"))
    return d.join(F.broadcast(w), "cls").groupBy("seq", "frame").agg(F.round(F.sum("inverse"), 8).alias("weight"))
