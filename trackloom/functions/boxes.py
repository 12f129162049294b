"""Box expressions. A box is four columns (left, top, right, bottom) unless said otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", alias: str = "") -> Box:
    """Corner columns from x, y, w, h columns."""
    c = lambda n: F.col(f"{alias}.{prefix}{n}" if alias else prefix + n)
    return c("x"), c("y"), c("x") + c("w"), c("y") + c("h")


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def _share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is no area."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def iou(a: Box, b: Box) -> Column:
    i = intersection(a, b)
    return _share(i, area(a) + area(b) - i)


def ioa(a: Box, b: Box) -> Column:
    """Intersection over the area of ``a``."""
    return _share(intersection(a, b), area(a))


def hull(a: Box, b: Box) -> Box:
    return F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])


def giou(a: Box, b: Box) -> Column:
    i, c = intersection(a, b), area(hull(a, b))
    u = area(a) + area(b) - i
    return _share(i, u) - _share(c - u, c)


def centre(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def centre_gap2(a: Box, b: Box) -> Column:
    (ax, ay), (bx, by) = centre(a), centre(b)
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def diou(a: Box, b: Box) -> Column:
    c = hull(a, b)
    return iou(a, b) - _share(centre_gap2(a, b), (c[2] - c[0]) * (c[2] - c[0]) + (c[3] - c[1]) * (c[3] - c[1]))


def ciou(a: Box, b: Box) -> Column:
    """DIoU less the aspect term v^2 / (1 - IoU + v)."""
    turn = lambda x: F.atan((x[2] - x[0]) / (x[3] - x[1]))
    v = 4 / math.pi**2 * F.pow(turn(a) - turn(b), F.lit(2.0))
    return diou(a, b) - _share(v * v, 1 - iou(a, b) + v)


def height_iou(a: Box, b: Box) -> Column:
    """Share of the joint height span that both boxes cover."""
    over = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return _share(F.greatest(F.lit(0.0), over), F.greatest(a[3], b[3]) - F.least(a[1], b[1]))


def hmiou(a: Box, b: Box) -> Column:
    return iou(a, b) * height_iou(a, b)


def euclidean_similarity(a: Box, b: Box, zero: float) -> Column:
    """1 at the same centre, 0 from a distance of ``zero`` on."""
    return F.greatest(F.lit(0.0), 1 - F.sqrt(centre_gap2(a, b)) / zero)


def to_xyah(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    return [x + w / 2, y + h / 2, w / h, h]


def to_state(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    """Centre, area and aspect."""
    return [x + w / 2, y + h / 2, w * h, w / h]


def from_state(u: Column, v: Column, s: Column, r: Column) -> list[Column]:
    w = F.sqrt(s * r)
    return [u - w / 2, v - s / w / 2, u + w / 2, v + s / w / 2]


def cell(b: Box, width: float, height: float, grid: int = 32, from_centre: bool = False) -> Column:
    """Grid cell (row * grid + column) of the bottom centre, or the centre."""
    column = F.floor((b[0] + b[2]) / 2 / width * grid)
    row = F.floor(((b[1] + b[3]) / 2 if from_centre else b[3]) / height * grid)
    inside = lambda v: F.greatest(F.lit(0), F.least(F.lit(grid - 1), v))
    return (inside(row) * grid + inside(column)).cast("long")


def clipped(b: Box, width: Column, height: Column) -> Box:
    """Corners kept inside a picture."""
    kept = lambda v, top: F.greatest(F.lit(0.0), F.least(v.cast("double"), top.cast("double")))
    return kept(b[0], width), kept(b[1], height), kept(b[2], width), kept(b[3], height)


def normalised(b: Box, width: Column, height: Column) -> list[Column]:
    """Centre and size as shares of a picture."""
    return [(b[0] + b[2]) / 2 / width, (b[1] + b[3]) / 2 / height, (b[2] - b[0]) / width, (b[3] - b[1]) / height]


def rescaled(b: Box, inner: tuple[Column, Column], outer: tuple[Column, Column]) -> Box:
    """Corners in a picture (width, height) that was fitted, with equal borders, into ``inner``, back in ``outer``, and clipped to it."""
    gain = F.least(inner[0] / outer[0], inner[1] / outer[1])
    px, py = (inner[0] - outer[0] * gain) / 2, (inner[1] - outer[1] * gain) / 2
    return clipped(((b[0] - px) / gain, (b[1] - py) / gain, (b[2] - px) / gain, (b[3] - py) / gain), *outer)
