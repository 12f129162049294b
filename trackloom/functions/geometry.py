"""Segments, sides, polygons, principal axes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def turn(a: Point, b: Point, c: Point) -> Column:
    """Sign of the turn from ab to ac: 1 left, -1 right, 0 straight on."""
    return F.signum((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))


def within(a: Point, b: Point, p: Point) -> Column:
    """p, known to be on the line ab, lies on the segment."""
    return p[0].between(F.least(a[0], b[0]), F.greatest(a[0], b[0])) & p[1].between(F.least(a[1], b[1]), F.greatest(a[1], b[1]))


def crossing(p: Point, q: Point, a: Point, b: Point) -> Column:
    """0 if the step pq misses the line ab; else 1 or -1 by the side that it comes from. Touching counts."""
    d1, d2, d3, d4 = turn(a, b, p), turn(a, b, q), turn(p, q, a), turn(p, q, b)
    meets = (d1 != d2) & (d3 != d4)
    touch = ((d1 == 0) & within(a, b, p)) | ((d2 == 0) & within(a, b, q)) | ((d3 == 0) & within(p, q, a)) | ((d4 == 0) & within(p, q, b))
    return F.when(meets | touch, F.when(d1 != 0, d1).otherwise(-d2)).otherwise(0).cast("int")


def in_polygon(p: Point, vertices: list[tuple[float, float]]) -> Column:
    """Even-odd rule over the polygon's edges."""
    inside = F.lit(False)
    for (x1, y1), (x2, y2) in zip(vertices, vertices[1:] + vertices[:1], strict=True):
        if y1 == y2:
            continue
        spans = (F.lit(y1) > p[1]) != (F.lit(y2) > p[1])
        inside = inside != (spans & (p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1))
    return inside


def reference_point(x: Column, y: Column, w: Column, h: Column, side: Column) -> list[Column]:
    """Middle of the named side of a box, or its centre."""
    cx = F.when(side == "left", x).when(side == "right", x + w).otherwise(x + w / 2)
    cy = F.when(side == "top", y).when(side == "bottom", y + h).otherwise(y + h / 2)
    return [cx, cy]


def principal_axis(x: Column, y: Column) -> tuple[Column, Column]:
    """Aggregates: angle in degrees of the main axis of points, and the share of variance along it."""
    sx, sy, c = F.var_samp(x), F.var_samp(y), F.covar_samp(x, y)
    c = F.when(c * c > 1e-24 * sx * sy, c).otherwise(c * 0 + 0.0)  # rounding noise has a sign, which would turn an upright axis around
    root = F.sqrt((sx - sy) * (sx - sy) + 4 * c * c)
    return F.degrees(F.atan2(2 * c, sx - sy)) / 2, F.try_divide((sx + sy + root) / 2, sx + sy)
