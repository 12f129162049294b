"""Tracking accuracy queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import views as V
from ..metrics import kernels as K
from ..metrics.frames import clear_scores, per_sequence, sides, with_total
from ..operators import joins as J
from ..operators.pairs import frame_pairs
from ..registry import query

CLEAR = "tp long, fn long, fp long, idsw long, frag long, mt long, pt long, ml long, sim_sum double, frames long"
HOTA = "alpha double, tp long, fn long, fp long, ass_sum double, re_sum double, pr_sum double, loc_sum double"


def _sides(spark, sf_dir) -> DataFrame:
    return sides(V.ground_truth(spark, sf_dir), V.tracks(spark, sf_dir))


@query("JN1 JN18 RET10", f"WITH {V.PAIRS} SELECT seq, frame, gid, tid, round(iou, 6) AS sim FROM iou WHERE iou > 0")
def iou_pairs(spark, sf_dir):
    out = frame_pairs(V.ground_truth(spark, sf_dir), V.tracks(spark, sf_dir), touching=True)
    return out.withColumn("sim", F.round("sim", 6))


_MATCHES = f"""WITH {V.PAIRS},
run AS (SELECT *, lag(tid) OVER (PARTITION BY seq, gid ORDER BY frame) AS prev FROM hit),
sw AS (SELECT seq, count(*) AS tp, sum(iou) AS s, sum(CASE WHEN prev IS NOT NULL AND prev <> tid THEN 1 ELSE 0 END) AS idsw FROM run GROUP BY seq),
g AS (SELECT seq, count(*) AS n FROM gt GROUP BY seq), t AS (SELECT seq, count(*) AS n FROM trk GROUP BY seq),
per AS (SELECT g.seq, tp, g.n - tp AS fn, t.n - tp AS fp, idsw, s FROM g JOIN t USING (seq) JOIN sw USING (seq)),
al AS (SELECT * FROM per UNION ALL SELECT -1, sum(tp), sum(fn), sum(fp), sum(idsw), sum(s) FROM per)"""


@query("AGG36 AGG44 SNK5 UDF2", _MATCHES + """
SELECT seq, tp::BIGINT AS tp, fn::BIGINT AS fn, fp::BIGINT AS fp, idsw::BIGINT AS idsw, round((tp - fp - idsw) / (tp + fn), 6) AS mota, round(s / tp, 6) AS motp,
  round((tp - fp) / (tp + fn), 6) AS moda, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + 0.5 * fn + 0.5 * fp), 6) AS f1,
  round((s - fp - idsw) / (tp + fn), 6) AS smota FROM al""")  # fmt: skip
def clear_mot_by_sequence(spark, sf_dir):
    """MOTA and its parts per sequence and in total (seq -1)."""
    per = per_sequence(_sides(spark, sf_dir), K.clear, CLEAR)
    total = with_total(per, ["tp", "fn", "fp", "idsw", "sim_sum"])
    return clear_scores(total).drop("sim_sum")


@query("AGG36", f"""WITH {V.PAIRS},
n AS (SELECT seq, id, count(*) AS n FROM gt GROUP BY ALL), m AS (SELECT seq, gid AS id, count(*) AS m FROM hit GROUP BY ALL),
r AS (SELECT n.seq, coalesce(m, 0) / n.n AS r FROM n LEFT JOIN m USING (seq, id))
SELECT seq, sum((r > 0.8)::INT)::BIGINT AS mt, sum((r <= 0.8 AND r >= 0.2)::INT)::BIGINT AS pt, sum((r < 0.2)::INT)::BIGINT AS ml FROM r GROUP BY seq""")  # fmt: skip
def tracked_share_classes(spark, sf_dir):
    return per_sequence(_sides(spark, sf_dir), K.clear, CLEAR).select("seq", "mt", "pt", "ml")


@query("AGG36")
def fragments(spark, sf_dir):
    """Fragments reset on frames that have both sides only, so SQL windows can't express them; held against a unit test."""
    return per_sequence(_sides(spark, sf_dir), K.clear, CLEAR).select("seq", "frag", "frames")


@query("AGG37 AGG48 JN10 JN11")
def identity_f1(spark, sf_dir):
    """IDF1 over the least-cost identity mapping; needs a global assignment, so brute force on small cases is its test."""
    per = with_total(per_sequence(_sides(spark, sf_dir), K.identity, "idtp long, idfn long, idfp long"), ["idtp", "idfn", "idfp"])
    tp, fn, fp = F.col("idtp"), F.col("idfn"), F.col("idfp")
    return per.withColumns({"idf1": F.round(tp / (tp + 0.5 * fn + 0.5 * fp), 6), "idr": F.round(tp / (tp + fn), 6), "idp": F.round(tp / (tp + fp), 6)})


@query("AGG34 AGG35")
def hota_by_sequence(spark, sf_dir):
    """HOTA per sequence and combined: DetA and AssA geometric mean per alpha, then the mean over alphas."""
    per = per_sequence(_sides(spark, sf_dir), K.hota, HOTA)
    sums = ["tp", "fn", "fp", "ass_sum", "re_sum", "pr_sum", "loc_sum"]
    total = per.groupBy("alpha").agg(*[F.sum(c).alias(c) for c in sums]).withColumn("seq", F.lit(-1).cast("long"))
    both = per.unionByName(total)
    tp = F.greatest(F.lit(1), F.col("tp"))
    det = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn") + F.col("fp"))
    each = both.withColumns({"deta": det, "assa": F.col("ass_sum") / tp, "assre": F.col("re_sum") / tp, "asspr": F.col("pr_sum") / tp, "loca": F.col("loc_sum") / tp})
    each = each.withColumn("hota", F.sqrt(F.col("deta") * F.col("assa")))
    return each.groupBy("seq").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("hota", "deta", "assa", "assre", "asspr", "loca")])


@query("AGG34", f"""WITH {V.PAIRS}, a AS (SELECT range * 5 AS pct FROM range(1, 20)),
g AS (SELECT seq, count(*) AS n FROM gt GROUP BY seq), t AS (SELECT seq, count(*) AS n FROM trk GROUP BY seq),
m AS (SELECT seq, pct, count(*) AS tp FROM iou, a WHERE iou >= pct / 100 - 1e-12 GROUP BY ALL)
SELECT seq, pct::BIGINT AS pct, coalesce(tp, 0)::BIGINT AS tp, round(coalesce(tp, 0) / (g.n + t.n - coalesce(tp, 0)), 6) AS deta FROM g JOIN t USING (seq) CROSS JOIN a LEFT JOIN m USING (seq, pct)""")  # fmt: skip
def detection_accuracy_by_alpha(spark, sf_dir):
    """DetA of each alpha (given in hundredths), by explode instead of a loop."""
    per = per_sequence(_sides(spark, sf_dir), K.hota, HOTA)
    return per.select("seq", F.round(F.col("alpha") * 100).cast("long").alias("pct"), "tp", F.round(F.col("tp") / (F.col("tp") + F.col("fn") + F.col("fp")), 6).alias("deta"))


@query("AGG38", f"""WITH {V.PAIRS}, c AS (SELECT seq, gid, tid, count(*) AS n FROM hit GROUP BY ALL), s AS (SELECT seq, gid, max(n) / sum(n) AS share FROM c GROUP BY ALL)
SELECT seq, count(*) AS ids, round(avg(share), 6) AS idcons FROM s GROUP BY seq""")  # fmt: skip
def id_consistency(spark, sf_dir):
    per = per_sequence(_sides(spark, sf_dir), K.id_consistency, "share_sum double, ids long")
    return per.select("seq", "ids", F.round(F.col("share_sum") / F.col("ids"), 6).alias("idcons"))


@query("AGG38", f"""WITH {V.PAIRS}, c AS (SELECT seq, gid, tid, count(*) AS n FROM hit GROUP BY ALL)
SELECT seq, gid, sum(n)::BIGINT AS matches, max(n)::BIGINT AS most, count(*) AS partners FROM c GROUP BY ALL""")  # fmt: skip
def partners_by_ground_truth(spark, sf_dir):
    """Modal partner counts per ground truth id, in SQL operators only (threshold join, partial aggregation)."""
    hits = frame_pairs(V.ground_truth(spark, sf_dir), V.tracks(spark, sf_dir), least=0.5)
    counts = hits.groupBy("seq", "gid", "tid").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("seq", "gid").agg(F.sum("n").alias("matches"), F.max("n").alias("most"), F.count(F.lit(1)).alias("partners"))


@query("AGG39")
def vace_scores(spark, sf_dir):
    per = per_sequence(_sides(spark, sf_dir), K.vace, "stda double, ata double, fda double, frames long")
    return per.select("seq", F.round("stda", 6).alias("stda"), F.round("ata", 6).alias("ata"), F.round(F.col("fda") / F.col("frames"), 6).alias("sfda"))


@query("AGG40")
def matched_path_share(spark, sf_dir):
    """Share of the ground truth's path length that its partner follows; boxes move with n here so that paths have length."""
    gt = V.ground_truth(spark, sf_dir).withColumn("y", F.col("y") + F.col("n") % 5)
    rows = sides(gt, V.tracks(spark, sf_dir)).join(gt.select("seq", "frame", F.col("id").alias("gid"), (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy")), ["seq", "frame", "gid"], "left")

    def run(pdf):
        import pandas as pd

        own = pdf.dropna(subset=["gid"])
        at = [own[c].to_numpy(kind) for c, kind in (("frame", "int64"), ("gid", "int64"), ("cx", float), ("cy", float))]
        return pd.DataFrame({"seq": [pdf["seq"].iloc[0]], "ideucl": [round(K.mean_path_share(K.Sequence(pdf), *at), 6)]})

    return rows.groupBy("seq").applyInPandas(run, "seq long, ideucl double")


@query("AGG43", f"""WITH {V.TRK}, g AS (SELECT seq, count(*) AS gt_dets, count(DISTINCT id) AS gt_ids, count(DISTINCT frame) AS frames FROM gt GROUP BY seq),
t AS (SELECT seq, count(*) AS dets, count(DISTINCT id) AS ids FROM trk GROUP BY seq) SELECT * FROM g JOIN t USING (seq)""")  # fmt: skip
def count_metric(spark, sf_dir):
    g = V.ground_truth(spark, sf_dir).groupBy("seq").agg(F.count(F.lit(1)).alias("gt_dets"), F.countDistinct("id").alias("gt_ids"), F.countDistinct("frame").alias("frames"))
    t = V.tracks(spark, sf_dir).groupBy("seq").agg(F.count(F.lit(1)).alias("dets"), F.countDistinct("id").alias("ids"))
    return g.join(t, "seq")


EVENT_LOG = "frame long, type string, oid long, hid long, d double"


def event_log(spark, sf_dir) -> DataFrame:
    return per_sequence(_sides(spark, sf_dir), K.events, EVENT_LOG)


_EVENTS = f"""WITH {V.PAIRS},
run AS (SELECT *, lag(tid) OVER (PARTITION BY seq, gid ORDER BY frame) AS prev FROM hit),
c AS (SELECT seq, count(*) AS detections, sum((prev IS NOT NULL AND prev <> tid)::INT) AS switches, sum(1 - iou) AS dist FROM run GROUP BY seq),
g AS (SELECT seq, count(*) AS objects, count(DISTINCT id) AS unique_objects FROM gt GROUP BY seq), t AS (SELECT seq, count(*) AS predictions FROM trk GROUP BY seq)"""


@query("TRK15 AGG45 JN39 RET15", _EVENTS + """
SELECT seq, (detections - switches)::BIGINT AS matches, switches::BIGINT AS switches, (objects - detections)::BIGINT AS misses, (predictions - detections)::BIGINT AS false_positives,
  detections::BIGINT AS detections, objects, predictions, unique_objects FROM c JOIN g USING (seq) JOIN t USING (seq)""")  # fmt: skip
def accumulator_counters(spark, sf_dir):
    n = lambda *kinds: F.count_if(F.col("type").isin(*kinds))
    return event_log(spark, sf_dir).groupBy("seq").agg(
        n("MATCH").alias("matches"), n("SWITCH").alias("switches"), n("MISS").alias("misses"), n("FP").alias("false_positives"), n("MATCH", "SWITCH").alias("detections"),
        n("MATCH", "SWITCH", "MISS").alias("objects"), n("MATCH", "SWITCH", "FP").alias("predictions"), F.countDistinct("oid").alias("unique_objects"))


@query("AGG47 AGG49", _EVENTS + """
, p AS (SELECT seq, detections AS d, switches AS s, dist, objects AS o, predictions AS p FROM c JOIN g USING (seq) JOIN t USING (seq)),
al AS (SELECT * FROM p UNION ALL SELECT -1, sum(d), sum(s), sum(dist), sum(o), sum(p) FROM p)
SELECT seq, round(1 - ((o - d) + s + (p - d)) / o, 6) AS mota, round(dist / d, 6) AS motp, round(d / p, 6) AS precision, round(d / o, 6) AS recall FROM al""")  # fmt: skip
def accumulator_scores(spark, sf_dir):
    """Scores per sequence and merged: partial sums add up, ratios are taken last."""
    hit, n = F.col("type").isin("MATCH", "SWITCH"), lambda c: F.count_if(c)
    per = event_log(spark, sf_dir).groupBy("seq").agg(n(hit).alias("d"), n(F.col("type") == "SWITCH").alias("s"), n(F.col("type") == "MISS").alias("miss"), n(F.col("type") == "FP").alias("fp"), F.sum(F.when(hit, F.col("d"))).alias("dist"))
    total = per.select(F.lit(-1).cast("long").alias("seq"), "d", "s", "miss", "fp", "dist").groupBy("seq").agg(*[F.sum(c).alias(c) for c in ("d", "s", "miss", "fp", "dist")])
    both, o = per.unionByName(total), F.col("d") + F.col("miss")
    return both.select("seq", F.round(1 - F.try_divide(F.col("miss") + F.col("s") + F.col("fp"), o), 6).alias("mota"), F.round(F.try_divide(F.col("dist"), F.col("d").cast("double")), 6).alias("motp"),
                       F.round(F.try_divide(F.col("d").cast("double"), F.col("d") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide(F.col("d").cast("double"), o), 6).alias("recall"))


@query("AGG46", f"""WITH {V.PAIRS}, a AS (SELECT gt.seq, gt.id, gt.frame, hit.tid IS NOT NULL AS ok FROM gt LEFT JOIN hit ON gt.seq = hit.seq AND gt.frame = hit.frame AND gt.id = hit.gid),
b AS (SELECT *, lag(ok) OVER (PARTITION BY seq, id ORDER BY frame) AS was, max(CASE WHEN ok THEN frame END) OVER (PARTITION BY seq, id) AS last, min(CASE WHEN ok THEN frame END) OVER (PARTITION BY seq, id) AS first FROM a)
SELECT seq, id, round(avg(ok::INT), 6) AS track_ratio, sum((was AND NOT ok AND frame BETWEEN first AND last)::INT)::BIGINT AS fragmentations FROM b GROUP BY ALL""")  # fmt: skip
def accumulator_track_ratios(spark, sf_dir):
    """Tracked share of each object, and how often it is lost between its first and last detection."""
    log = event_log(spark, sf_dir).filter("type in ('MATCH', 'SWITCH', 'MISS')").withColumn("ok", F.col("type") != "MISS")
    by = Window.partitionBy("seq", "oid")
    seen = log.withColumns({"was": F.lag("ok").over(by.orderBy("frame")), "first": F.min(F.when(F.col("ok"), F.col("frame"))).over(by), "last": F.max(F.when(F.col("ok"), F.col("frame"))).over(by)})
    lost = F.col("was") & ~F.col("ok") & F.col("frame").between(F.col("first"), F.col("last"))
    return seen.groupBy("seq", F.col("oid").alias("id")).agg(F.round(F.avg(F.col("ok").cast("int")), 6).alias("track_ratio"), F.count_if(lost).alias("fragmentations"))


@query("AGG42", f"WITH {V.PAIRS}, p AS (SELECT seq, gid, tid, sum(iou) AS s FROM iou WHERE iou > 0 GROUP BY ALL), b AS (SELECT seq, gid, max(s) AS s FROM p GROUP BY ALL), n AS (SELECT seq, id AS gid, count(*) AS n FROM gt GROUP BY ALL) SELECT seq, gid, round(coalesce(s, 0) / n, 6) AS j FROM n LEFT JOIN b USING (seq, gid)")
def region_similarity(spark, sf_dir):
    """Region score of masks: each ground truth's mean IoU, over its frames, with the track that is assigned to it.

    Sums per pair of ids are plain aggregates; what goes to the one-to-one assignment of a sequence is a row for each pair
    that ever overlaps. The SQL takes the best track of each ground truth, which is the same while no track overlaps two; from a
    thousand users on, tracks of two users share an id, and one of the two goes to the one-to-one assignment's next best.
    """
    mask = lambda b: b.withColumn("mask", F.array(F.struct((F.col("y") * 10000 + F.col("x")).cast("long").alias("start"), F.col("w").cast("long").alias("length"))))
    gt = V.ground_truth(spark, sf_dir)
    both = mask(gt).alias("g").join(mask(V.tracks(spark, sf_dir)).alias("t"), [F.col("g.seq") == F.col("t.seq"), F.col("g.frame") == F.col("t.frame")])
    iou = both.select(F.col("g.seq").alias("seq"), F.col("g.id").alias("gid"), F.col("t.id").alias("tid"), J.mask_iou(F.col("g.mask"), F.col("t.mask")).alias("iou")).filter("iou > 0")
    n = gt.groupBy("seq", F.col("id").alias("gid")).agg(F.count(F.lit(1)).alias("n"))
    share = iou.groupBy("seq", "gid", "tid").agg(F.sum("iou").alias("s")).join(n, ["seq", "gid"]).select("seq", "gid", "tid", (F.col("s") / F.col("n")).alias("j"))
    found = share.groupBy("seq").applyInPandas(K.assigned_shares, "seq long, gid long, j double")
    return n.join(found, ["seq", "gid"], "left").select("seq", "gid", F.round(F.coalesce("j", F.lit(0.0)), 6).alias("j"))
