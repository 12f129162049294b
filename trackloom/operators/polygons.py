"""Polygons against boxes: a spatial join by grid cells, with the exact common area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let


def polygon_area(vertices: Column) -> Column:
    """Area of a simple polygon, an array of (x, y), whichever way round it is."""
    following = F.concat(F.slice(vertices, F.lit(2), F.greatest(F.size(vertices) - 1, F.lit(0))), F.slice(vertices, 1, 1))
    turns = F.zip_with(vertices, following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(turns, F.lit(0.0), lambda s, t: s + t)) / 2


def common_area(vertices: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Area that a simple polygon, convex or not, shares with a box.

    At any x the polygon's section within the box is the signed sum of its edges' heights there, each kept between top and
    bottom. So the area is the sum over edges of the integral of that height, which has a closed form: no clipped polygon
    is ever built.
    """
    height = bottom - top
    kept = lambda v, low, high: F.greatest(low, F.least(high, v))
    # Integral of (kept(y) - top) from top to y.
    risen = lambda y: F.when(y <= top, 0.0).when(y >= bottom, height * height / 2 + height * (y - bottom)).otherwise((y - top) * (y - top) / 2)

    def edge(a: Column, b: Column) -> Column:
        xa, xb = kept(a["x"], left, right), kept(b["x"], left, right)
        at = lambda x: a["y"] + (x - a["x"]) * (b["y"] - a["y"]) / (b["x"] - a["x"])
        ends = F.struct(at(xa).alias("p"), at(xb).alias("q"), (xb - xa).alias("dx"))
        mean = lambda e: F.when(F.abs(e["q"] - e["p"]) > 1e-9, (risen(e["q"]) - risen(e["p"])) / (e["q"] - e["p"])).otherwise(kept(e["p"], top, bottom) - top)
        return F.when(xa == xb, 0.0).otherwise(let(ends, lambda e: e["dx"] * mean(e)))

    following = F.concat(F.slice(vertices, F.lit(2), F.greatest(F.size(vertices) - 1, F.lit(0))), F.slice(vertices, 1, 1))
    return F.abs(F.aggregate(F.zip_with(vertices, following, edge), F.lit(0.0), lambda s, t: s + t))


def polygons_on_boxes(polygons: DataFrame, boxes: DataFrame, keys: list[str], cell: float, least: float = 0.0, of: str = "box") -> DataFrame:
    """Pairs of a polygon (keys, polygon, vertices: array of x, y) and a box (keys, x, y, w, h, ...) that share more than ``least`` of the area of the ``of`` ("box" or "polygon").

    Both go to the cells of a square grid that their hulls cover, and meet in those: an equi-join on keys and cell, which a
    hot camera or cell does not stop from being split. A pair is taken only in the cell where the overlap of the hulls
    begins, so it comes once. Polygons without area and boxes without any are in no pair; the columns of the boxes stay, with
    polygon, common and share.
    """
    grid = lambda v: F.floor(v / cell)
    span = lambda a, b: F.explode(F.sequence(a, b))
    xs, ys = F.transform("vertices", lambda v: v["x"].cast("double")), F.transform("vertices", lambda v: v["y"].cast("double"))
    shape = polygons.select(*keys, "polygon", F.arrays_zip(xs.alias("x"), ys.alias("y")).alias("__v")).withColumn("__area", polygon_area(F.col("__v"))).filter("__area > 0")
    low, high = (lambda c: F.array_min(F.transform("__v", lambda v: v[c]))), (lambda c: F.array_max(F.transform("__v", lambda v: v[c])))
    shape = shape.select("*", low("x").alias("__l"), low("y").alias("__t"), high("x").alias("__r"), high("y").alias("__b"))
    shape = shape.select("*", span(grid(F.col("__l")), grid(F.col("__r"))).alias("__cx")).select("*", span(grid(F.col("__t")), grid(F.col("__b"))).alias("__cy")).alias("p")
    right, bottom = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    dealt = boxes.filter("w > 0 and h > 0").select("*", span(grid(F.col("x")), grid(right)).alias("__cx")).select("*", span(grid(F.col("y")), grid(bottom)).alias("__cy")).alias("b")
    on = [F.col(f"p.{k}") == F.col(f"b.{k}") for k in [*keys, "__cx", "__cy"]]
    starts = lambda at, a, b: F.col(f"b.{at}") == grid(F.greatest(F.col(a), F.col(b)))
    x, y, w, h = (F.col(f"b.{c}").cast("double") for c in ("x", "y", "w", "h"))
    meets = (F.col("p.__l") < x + w) & (x < F.col("p.__r")) & (F.col("p.__t") < y + h) & (y < F.col("p.__b"))
    once = starts("__cx", "p.__l", "b.x") & starts("__cy", "p.__t", "b.y")
    # The planner takes polygons dealt to cells for as small as their table, and would broadcast them through the driver.
    pairs = dealt.join(shape.hint("merge"), [*on, meets, once])
    whole = {"box": w * h, "polygon": F.col("p.__area")}[of]
    out = pairs.select(*[F.col(f"b.{c}").alias(c) for c in boxes.columns], F.col("p.polygon").alias("polygon"), common_area(F.col("p.__v"), x, y, x + w, y + h).alias("common"), whole.alias("__whole"))
    return out.withColumn("share", F.col("common") / F.col("__whole")).filter(F.col("share") > least).drop("__whole")
