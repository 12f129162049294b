"""Shelves, and alert rules with a memory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import views as V
from ..operators import cases as C
from ..operators import joins as J
from ..operators import shelves as S
from ..registry import query
from .places import SHAPES

D = f"WITH {V.DET}"


def _shelf(spark, sf_dir):
    """A hexagonal shelf for each supplier; boxes of even users are empty places, those of odd ones stand in front."""
    k = F.col("s_suppkey")
    p = V.table(spark, sf_dir, "supplier").select((k % 8).alias("seq"), k.alias("polygon"), (k * 37 % 700).alias("cx"), (k * 53 % 560).alias("cy"), (k % 30 + 20).alias("r"))
    shelves = p.select("seq", "polygon", F.array(*[F.struct((F.col("cx") + F.col("r") * x).alias("x"), (F.col("cy") + F.col("r") * y).alias("y")) for x, y in SHAPES[0]]).alias("vertices"))
    boxes = V.tracks(spark, sf_dir).withColumn("y", F.col("y") + F.col("id") * 17 % 500)
    return S.occupancy(shelves, boxes.filter("id % 2 = 0"), boxes.filter("id % 2 = 1"), boxes.select("seq", "frame").distinct(), 64.0, 0.2)


_SHELF = f"""WITH {V.TRK}, bx AS (SELECT seq, frame, id, x AS l, y + id * 17 % 500 AS t, x + w AS r, y + id * 17 % 500 + h AS b FROM trk),
p AS (SELECT s_suppkey % 8 AS seq, s_suppkey AS polygon, s_suppkey * 37 % 700 AS cx, s_suppkey * 53 % 560 AS cy, s_suppkey % 30 + 20 AS rad FROM supplier),
v AS (SELECT seq, polygon, i, cx + rad * dx AS x, cy + rad * dy AS y FROM p, (VALUES {", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(SHAPES[0]))}) o(i, dx, dy)),
e AS (SELECT seq, polygon, x AS x1, y AS y1, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM v WINDOW w AS (PARTITION BY polygon ORDER BY i)),
hull AS (SELECT seq, polygon, min(x1) AS pl, max(x1) AS pr, min(y1) AS pt, max(y1) AS pb, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area FROM e GROUP BY ALL),
near AS (SELECT bx.*, polygon, area FROM bx JOIN hull USING (seq) WHERE pl < r AND l < pr AND pt < b AND t < pb),
c AS (SELECT n.*, x1, y1, x2, y2, greatest(l, least(r, x1)) AS xa, greatest(l, least(r, x2)) AS xb FROM near n JOIN e USING (seq, polygon)),
g AS (SELECT *, y1 + (xa - x1) * (y2 - y1) / (x2 - x1) AS ya, y1 + (xb - x1) * (y2 - y1) / (x2 - x1) AS yb FROM c WHERE xa <> xb),
k AS (SELECT *, CASE WHEN ya <= t THEN 0 WHEN ya >= b THEN (b - t) * (b - t) / 2 + (b - t) * (ya - b) ELSE (ya - t) * (ya - t) / 2 END AS ka, CASE WHEN yb <= t THEN 0 WHEN yb >= b THEN (b - t) * (b - t) / 2 + (b - t) * (yb - b) ELSE (yb - t) * (yb - t) / 2 END AS kb FROM g),
a AS (SELECT seq, frame, id, polygon, area, abs(sum((xb - xa) * CASE WHEN abs(yb - ya) > 1e-9 THEN (kb - ka) / (yb - ya) ELSE greatest(t, least(b, ya)) - t END)) AS common FROM k GROUP BY ALL),
cov AS (SELECT seq, frame, polygon, sum(common / area) FILTER (id % 2 = 0) AS bare, sum(common / area) FILTER (id % 2 = 1) AS hides FROM a GROUP BY ALL),
shelf AS (SELECT seq, frame, polygon, greatest(0, 1 - coalesce(bare, 0)) AS occupancy, coalesce(hides, 0) > 0.2 AS occluded FROM (SELECT DISTINCT seq, frame FROM bx) JOIN hull USING (seq) LEFT JOIN cov USING (seq, frame, polygon))"""


@query("STR34", _SHELF + """, m AS (SELECT seq, polygon, frame // 24 AS period, avg(occupancy) FILTER (NOT occluded) AS mean, count(*) FILTER (NOT occluded) AS n FROM shelf GROUP BY ALL)
SELECT seq, polygon, period, round(last_value(mean IGNORE NULLS) OVER (PARTITION BY seq, polygon ORDER BY period ROWS UNBOUNDED PRECEDING), 6) AS occupancy, n FROM m""")  # fmt: skip
def shelf_history(spark, sf_dir):
    """Mean occupancy of each shelf and day, of samples that nothing hid."""
    return S.history(_shelf(spark, sf_dir), 24).withColumn("occupancy", F.round("occupancy", 6))


@query("STR32 STR33", _SHELF + """, s AS (SELECT *, CASE WHEN occupancy < 0.7 THEN 'low' WHEN occupancy > 0.85 AND NOT occluded THEN 'full' END AS state FROM shelf),
w AS (SELECT *, lag(state, 1, 'full') OVER (PARTITION BY seq, polygon ORDER BY frame) AS was FROM s WHERE state IS NOT NULL) SELECT seq, polygon, frame FROM w WHERE state = 'low' AND was = 'full'""")  # fmt: skip
def shelf_low(spark, sf_dir):
    """Shelves that fall below, told once until they are filled again."""
    return S.low(_shelf(spark, sf_dir), 0.7, 0.85)


@query("STR32 STR33", _SHELF + " SELECT seq, polygon, min(frame) AS frame FROM shelf WHERE occupancy < 0.7 AND NOT occluded GROUP BY seq, polygon, frame // 48")
def shelf_periodic(spark, sf_dir):
    """Shelves that are low, told once a period."""
    return S.periodic(_shelf(spark, sf_dir), 0.7, 48)


@query("STR32 STR33", _SHELF + """, f AS (SELECT *, max(occupancy) OVER (PARTITION BY seq, polygon ORDER BY frame RANGE BETWEEN 12 PRECEDING AND CURRENT ROW) - occupancy AS fall FROM shelf WHERE NOT occluded),
w AS (SELECT *, lag(fall, 1, 0) OVER (PARTITION BY seq, polygon ORDER BY frame) AS was FROM f) SELECT seq, polygon, frame, round(fall, 6) AS fall FROM w WHERE fall >= 0.25 - 1e-9 AND was < 0.25 - 1e-9""")  # fmt: skip
def shelf_drop(spark, sf_dir):
    """Shelves that lose a quarter within twelve frames."""
    return S.dropped(_shelf(spark, sf_dir), 12, 0.25).withColumn("fall", F.round("fall", 6))


@query("STR36")
def votes_with_cooldown(spark, sf_dir):
    """Users who stay, and of whose last votes most agree; then a day of silence."""
    e = V.events(spark, sf_dir).select("user_id", "ms", (F.col("value") >= 40).alias("vote"))
    return C.votes_with_cooldown(e, ["user_id"], 6 * 3_600_000, 48 * 3_600_000, 4, 0.7, 86_400_000)


@query("STR38")
def error_bursts(spark, sf_dir):
    """Three errors of a camera within four hours, none of them nearer than ten minutes; then eight hours of silence."""
    e = V.events(spark, sf_dir).filter("event_type = 'error'").select((F.col("user_id") % 8).alias("camera"), "ms")
    return C.bursts(e, ["camera"], 4 * 3_600_000, 600_000, 3, 8 * 3_600_000)


@query("STR9 JN30")
def seen_before(spark, sf_dir):
    """Candidates that are where an alert was, or near it and look like it, among the twenty places used last."""
    d = V.detections(spark, sf_dir).filter("score >= 0.3")
    looks = F.when(F.col("cell") % 11 > 0, F.array(F.col("id") % 7, F.col("id") % 5, F.col("cell") % 3))
    x = F.col("id") % 40 * 20 + F.col("cell") % 16
    return C.seen_before(d.select("seq", F.col("frame").alias("ms"), "id", "cls", x.alias("x"), "y", "w", "h", looks.alias("looks")), "seq", 20, 0.6, 0.95)


@query("STR17")
def lines_in_order(spark, sf_dir):
    """Users who pass three lines in their order within two days."""
    d = V.detections(spark, sf_dir).select("seq", "id", F.col("frame").alias("ms"), F.floor(F.col("cell") / 342).alias("line"))
    return C.lines_in_order(d, ["seq", "id"], 3, 2, 48).withColumn("speed", F.round(100 / (F.col("last") - F.col("first")), 6))


@query("STR43")
def held_matches(spark, sf_dir):
    """Matches of a person, told after an hour or three of them, and again after a day without any."""
    e = V.events(spark, sf_dir).filter("value >= 50").select("user_id", "ms", (F.col("event_id") % 8).alias("camera"), F.col("value").alias("score"))
    return C.held_matches(e, "user_id", 3_600_000, 3, 86_400_000)


@query("STR41")
def plates_told(spark, sf_dir):
    """Plates of vehicles that hold them best, a vehicle once, without those of parked cars."""
    g = V.ground_truth(spark, sf_dir)
    moved = g.withColumn("x", F.col("x") + F.when(F.col("id") % 3 == 0, F.col("frame")).otherwise(0))
    plate = moved.select("seq", "frame", F.col("id").alias("id"), (F.col("x") + 12).alias("x"), (F.col("y") + 20).alias("y"), F.lit(16.0).alias("w"), F.lit(6.0).alias("h"))
    own = J.best_overlap(plate, moved, ["seq", "frame"], 0.9)
    found = own.join(plate.withColumnRenamed("id", "part"), ["seq", "frame", "part"])
    rows = found.select("seq", F.col("frame").alias("ms"), (F.col("whole") + 1000 * F.floor(F.col("frame") / 240)).alias("vehicle"), F.concat(F.lit("P"), (F.col("part") % 50).cast("string")).alias("plate"), "x", "y", "w", "h")
    return C.plates_once(rows, "seq", 0.7, 72)


def zone_window(sensitivity: int, window: int = 48, least: float = 0.5) -> tuple[int, int]:
    """Window and presence in it that a sensitivity from 0 to 100 asks for: at 50 as given; more of it shortens the window, less lengthens it, each by half at most."""
    frames = round(window * (1 - (sensitivity - 50) / 100))
    return frames, max(2, round(frames * least * (1 - (sensitivity - 50) / 200)))


_WINDOW = zone_window(80, 240, 0.05)


@query("STR19", f"""{D}, n AS (SELECT seq, id, frame, count(*) OVER (PARTITION BY seq, id ORDER BY frame RANGE BETWEEN {_WINDOW[0] - 1} PRECEDING AND CURRENT ROW) AS n FROM det WHERE cell < 512),
w AS (SELECT *, lag(n, 1, 0) OVER (PARTITION BY seq, id ORDER BY frame) AS was FROM n) SELECT seq, id, frame, n FROM w WHERE n >= {_WINDOW[1]} AND was < {_WINDOW[1]}""")  # fmt: skip
def zone_protection(spark, sf_dir):
    """Entities that are in the zone often enough within a window, with or without leaving it: both follow from a sensitivity."""
    by = Window.partitionBy("seq", "id").orderBy("frame")
    n = V.detections(spark, sf_dir).filter("cell < 512").withColumn("n", F.count(F.lit(1)).over(by.rangeBetween(1 - _WINDOW[0], 0)))
    return n.withColumn("was", F.lag("n", 1, 0).over(by)).filter((F.col("n") >= _WINDOW[1]) & (F.col("was") < _WINDOW[1])).select("seq", "id", "frame", "n")


@query("STR37", f"""{D}, a AS (SELECT seq, id, frame, (w + (id * 7 + frame * 13 + n) % 1024 % 60) / (h + n * 7) AS ar FROM gt),
m AS (SELECT seq, id, frame, avg(ar) OVER (PARTITION BY seq, id ORDER BY frame ROWS BETWEEN 8 PRECEDING AND 3 PRECEDING) AS before, median(ar) OVER l AS now, count(*) OVER l AS k FROM a WINDOW l AS (PARTITION BY seq, id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT seq, id, frame, round(now / before, 6) AS ratio FROM m WHERE k = 3 AND now / before >= 1.4""")  # fmt: skip
def aspect_change(spark, sf_dir):
    """Boxes that get much wider for their height: the median of three against the mean of the six before."""
    by = Window.partitionBy("seq", "id").orderBy("frame")
    g = V.ground_truth(spark, sf_dir)
    cell = (F.col("id") * 7 + F.col("frame") * 13 + F.col("n")) % 1024
    a = g.withColumn("ar", (F.col("w") + cell % 60) / (F.col("h") + F.col("n") * 7))
    m = a.select("seq", "id", "frame", F.avg("ar").over(by.rowsBetween(-8, -3)).alias("before"), F.sort_array(F.collect_list("ar").over(by.rowsBetween(-2, 0))).alias("last"))
    ratio = F.get("last", F.lit(1)) / F.col("before")
    return m.filter(F.size("last") == 3).withColumn("ratio", ratio).filter("ratio >= 1.4").select("seq", "id", "frame", F.round("ratio", 6).alias("ratio"))


_MEANS = ", ".join(f"avg(c{k}) OVER (PARTITION BY seq ORDER BY frame ROWS BETWEEN 26 PRECEDING AND 3 PRECEDING) AS l{k}, avg(c{k}) OVER (PARTITION BY seq ORDER BY frame ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s{k}" for k in range(5))
_COST = " + ".join(f"abs(ln((s{k} + 1) / (l{k} + 1)))" for k in range(5))


@query("STR40", f"{D}, d AS (SELECT seq, frame, {', '.join(f'count(*) FILTER (cls = {k}) AS c{k}' for k in range(5))} FROM det GROUP BY ALL), m AS (SELECT seq, frame, {_MEANS} FROM d) SELECT seq, frame, round(({_COST}) / 5, 6) AS cost FROM m WHERE ({_COST}) / 5 > 0.2")
def tampering(spark, sf_dir):
    """Frames whose descriptor (counts of each class) differs from the longer past: the mean absolute log ratio of a short and a long mean."""
    d = V.detections(spark, sf_dir).groupBy("seq", "frame").agg(*[F.count_if(F.col("cls") == k).alias(f"c{k}") for k in range(5)])
    by = Window.partitionBy("seq").orderBy("frame")
    logs = [F.abs(F.log((F.avg(f"c{k}").over(by.rowsBetween(-2, 0)) + 1) / (F.avg(f"c{k}").over(by.rowsBetween(-26, -3)) + 1))) for k in range(5)]
    return d.select("seq", "frame", (sum(logs[1:], logs[0]) / 5).alias("cost")).filter("cost > 0.2").withColumn("cost", F.round("cost", 6))
