"""Polygons on boxes, and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions.rounding import rounded
from ..operators import polygons as P
from ..operators import routes as R
from ..registry import query

#: Outlines of two shapes, in radii about the centre: a hexagon and an arrow, which is not convex.
SHAPES = ([(1.0, 0.0), (0.5, 1.0), (-0.5, 1.0), (-1.0, 0.0), (-0.5, -1.0), (0.5, -1.0)], [(1.0, 0.0), (-1.0, 1.0), (-0.25, 0.0), (-1.0, -1.0)])


def outlines(spark, sf_dir):
    """seq, polygon, vertices: a polygon for each part, every third an arrow."""
    p = V.table(spark, sf_dir, "part").select((F.col("p_partkey") % 8).alias("seq"), F.col("p_partkey").alias("polygon"), (F.col("p_partkey") * 37 % 700).alias("cx"), (F.col("p_partkey") * 53 % 560).alias("cy"), (F.col("p_size") + 10).alias("r"))
    outline = lambda shape: F.array(*[F.struct((F.col("cx") + F.col("r") * x).alias("x"), (F.col("cy") + F.col("r") * y).alias("y")) for x, y in shape])
    return p.select("seq", "polygon", F.when(F.col("polygon") % 3 == 0, outline(SHAPES[1])).otherwise(outline(SHAPES[0])).alias("vertices"))


_CORNERS = ", ".join(f"({s}, {i}, {x}, {y})" for s, shape in enumerate(SHAPES) for i, (x, y) in enumerate(shape))


@query("JN21", f"""WITH {V.TRK}, bx AS (SELECT seq, frame, id, x AS l, y + id * 17 % 500 AS t, x + w AS r, y + id * 17 % 500 + h AS b FROM trk),
p AS (SELECT p_partkey % 8 AS seq, p_partkey AS polygon, p_partkey * 37 % 700 AS cx, p_partkey * 53 % 560 AS cy, p_size + 10 AS rad, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS s FROM part),
v AS (SELECT seq, polygon, i, cx + rad * dx AS x, cy + rad * dy AS y FROM p JOIN (VALUES {_CORNERS}) o(s, i, dx, dy) USING (s)),
e AS (SELECT seq, polygon, x AS x1, y AS y1, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM v WINDOW w AS (PARTITION BY polygon ORDER BY i)),
hull AS (SELECT seq, polygon, min(x) AS pl, max(x) AS pr, min(y) AS pt, max(y) AS pb FROM v GROUP BY ALL),
near AS (SELECT bx.*, polygon FROM bx JOIN hull USING (seq) WHERE pl < r AND l < pr AND pt < b AND t < pb),
c AS (SELECT n.*, x1, y1, x2, y2, greatest(l, least(r, x1)) AS xa, greatest(l, least(r, x2)) AS xb FROM near n JOIN e USING (seq, polygon)),
g AS (SELECT *, y1 + (xa - x1) * (y2 - y1) / (x2 - x1) AS ya, y1 + (xb - x1) * (y2 - y1) / (x2 - x1) AS yb FROM c WHERE xa <> xb),
k AS (SELECT *, CASE WHEN ya <= t THEN 0 WHEN ya >= b THEN (b - t) * (b - t) / 2 + (b - t) * (ya - b) ELSE (ya - t) * (ya - t) / 2 END AS ka, CASE WHEN yb <= t THEN 0 WHEN yb >= b THEN (b - t) * (b - t) / 2 + (b - t) * (yb - b) ELSE (yb - t) * (yb - t) / 2 END AS kb FROM g),
a AS (SELECT seq, frame, id, polygon, l, t, r, b, abs(sum((xb - xa) * CASE WHEN abs(yb - ya) > 1e-9 THEN (kb - ka) / (yb - ya) ELSE greatest(t, least(b, ya)) - t END)) AS common FROM k GROUP BY ALL)
SELECT seq, frame, id, polygon, round(common, 4) AS common, round(common / ((r - l) * (b - t)), 6) AS share FROM a WHERE common / ((r - l) * (b - t)) > 0.1""")  # fmt: skip
def polygons_on_boxes(spark, sf_dir):
    """Boxes of which a polygon of their sequence covers more than a tenth, with the exact common area."""
    boxes = V.tracks(spark, sf_dir).withColumn("y", F.col("y") + F.col("id") * 17 % 500)
    found = P.polygons_on_boxes(outlines(spark, sf_dir), boxes, ["seq"], 64.0, 0.1)
    return found.select("seq", "frame", "id", "polygon", rounded(F.col("common"), 4).alias("common"), rounded(F.round("share", 12), 6).alias("share"))


#: Small enough for the smallest tables.
ROUTES = R.Options(entities=4, match=0.6, percent=8.0, clusters=4, rounds=4)


def route_cells(spark, sf_dir):
    """key, entity, period, cell: half a period of a user is one entity, on the row of its kind, a column each hour of the day."""
    d = V.detections(spark, sf_dir)
    cell = (F.col("id") % 4 * 8 + F.col("n2")) * 32 + F.col("frame") % 24 + F.col("id") % 2
    return d.withColumn("n2", F.col("cell") % 2).select(F.col("seq").alias("key"), (F.col("id") * 100 + F.floor(F.col("frame") / 120)).alias("entity"), F.floor(F.col("frame") / 240).alias("period"), cell.alias("cell"))


@query("STR47")
def route_discovery(spark, sf_dir):
    """Routes of each third of the recording, found by matching and clustering the maps of all tracks."""
    cells = route_cells(spark, sf_dir)
    last = cells.agg(F.max("period")).first()[0]  # one number: periods follow one another
    out = R.discover(cells, range(0, (last or 0) + 1), ROUTES)
    return out.select("period", F.col("key").alias("seq"), "route", "hits", "end", F.array_join(F.col("cells").cast("array<string>"), ",").alias("cells"))
