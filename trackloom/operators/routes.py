"""Route discovery: cell maps of entities, matched to the routes known so far; what is left is clustered.

A route map says how often an entity was in each cell of the grid, divided by its greatest count. Maps and routes are kept
as rows of (entity or route, cell, weight), so that every comparison is an equi-join on the cell and nothing ever holds a
grid of all entities. Per period: maps go to the active route of greatest cosine, if that exceeds ``match``; routes with
enough hits live on as the cells that more than one of their maps holds; the maps left over are clustered by k-means and
matched to the centres in the same way; routes that overlap after closing their gaps are merged; some of the maps that still
have no route are carried over to the next period.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import saved


@dataclass(frozen=True)
class Options:
    grid: int = 32
    entities: int = 90  # maps from which on a period is searched
    match: float = 0.75  # least cosine with a route
    overlap: float = 0.5  # closed routes that share more than this are one
    percent: float = 4.0  # least hits of a route, in percent of the period's maps
    clusters: int = 10
    rounds: int = 10  # of k-means
    searched: float = 0.2  # share of ``entities`` that must be left for a search
    carried: float = 0.5  # share of ``entities`` that may be carried over
    seed: int = 7


def maps(cells: DataFrame) -> DataFrame:
    """key, entity, cell, w of rows (key, entity, cell): counts, divided by the entity's greatest."""
    n = cells.groupBy("key", "entity", "cell").agg(F.count(F.lit(1)).alias("n"))
    return n.select("key", "entity", "cell", (F.col("n") / F.max("n").over(Window.partitionBy("key", "entity"))).alias("w"))


def similarities(entities: DataFrame, routes: DataFrame) -> DataFrame:
    """key, entity, route, cosine of the pairs that share a cell."""
    norm = lambda t, name: t.groupBy("key", name).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias(f"norm_{name}"))
    both = entities.join(routes.select("key", "cell", "route", F.col("w").alias("v")), ["key", "cell"])
    dots = both.groupBy("key", "entity", "route").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    sized = dots.join(norm(entities, "entity"), ["key", "entity"]).join(norm(routes, "route"), ["key", "route"])
    return sized.select("key", "entity", "route", (F.col("dot") / (F.col("norm_entity") * F.col("norm_route"))).alias("cosine"))


def matched(entities: DataFrame, routes: DataFrame, total: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    """The entities (key, entity) of routes with enough hits, and those routes anew (key, route, cell, w, hits, end).

    Of routes that are alike to nine digits the first is taken; ``end`` is the cell of greatest mean weight.
    """
    best = similarities(entities, routes).groupBy("key", "entity").agg(F.max(F.struct(F.round("cosine", 9).alias("cosine"), (-F.col("route")).alias("route"))).alias("b"))
    near = best.filter(F.col("b.cosine") > o.match).select("key", "entity", (-F.col("b.route")).alias("route"))
    hits = near.groupBy("key", "route").agg(F.count(F.lit(1)).alias("hits")).join(total, "key").filter(F.col("hits") >= o.percent / 100 * F.col("total")).drop("total")
    own = saved(near.join(hits, ["key", "route"]))
    cells = entities.join(own, ["key", "entity"]).groupBy("key", "route", "cell", "hits").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("s"))
    end = F.max(F.struct(F.round("s", 9).alias("s"), (-F.col("cell")).alias("cell"))).over(Window.partitionBy("key", "route"))
    new = cells.withColumn("end", -end["cell"]).filter("n > 1").select("key", "route", "cell", F.lit(1.0).alias("w"), "hits", "end")
    return own.select("key", "entity"), new


def clustered(entities: DataFrame, o: Options) -> DataFrame:
    """Centres (key, route, cell, w) of k-means over sparse maps, distributed: dots by cell, means by cluster.

    Starts from the ``clusters`` maps of least hash in each key, so that a run can be repeated; ties go to the lower cluster.
    """
    order = Window.partitionBy("key").orderBy(F.xxhash64("entity", F.lit(o.seed)), "entity")
    first = entities.select("key", "entity").distinct().withColumn("route", F.row_number().over(order)).filter(F.col("route") <= o.clusters)
    centres = saved(entities.join(first, ["key", "entity"]).select("key", "route", "cell", "w"))
    square = lambda t, name: t.groupBy("key", name).agg(F.sum(F.col("w") * F.col("w")).alias(f"sq_{name}"))
    own = saved(square(entities, "entity"))
    for _ in range(o.rounds):
        dots = entities.join(centres.select("key", "cell", "route", F.col("w").alias("v")), ["key", "cell"]).groupBy("key", "entity", "route").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
        # Every map meets the few centres of its key, also those that it shares no cell with.
        far = own.join(square(centres, "route"), "key").join(dots, ["key", "entity", "route"], "left")
        far = far.select("key", "entity", "route", F.round(F.col("sq_entity") + F.col("sq_route") - 2 * F.coalesce("dot", F.lit(0.0)), 9).alias("far"))
        of = far.groupBy("key", "entity").agg(F.min(F.struct("far", "route")).alias("b")).select("key", "entity", F.col("b.route").alias("route"))
        n = of.groupBy("key", "route").agg(F.count(F.lit(1)).alias("n"))
        moved = entities.join(of, ["key", "entity"]).groupBy("key", "route", "cell").agg(F.sum("w").alias("s")).join(n, ["key", "route"]).select("key", "route", "cell", (F.col("s") / F.col("n")).alias("w"))
        empty = centres.join(n, ["key", "route"], "left_anti")  # no map is nearest: the centre stays
        centres = saved(moved.unionByName(empty))
    return centres


def closed(cells: np.ndarray, grid: int) -> np.ndarray:
    """Cells of a map after closing: grown by one cell to all sides, then shrunk; beyond the border nothing grows or shrinks."""
    around = lambda a, fill, pick: pick([np.pad(a, 1, constant_values=fill)[i : i + grid, j : j + grid] for i in range(3) for j in range(3)])
    a = np.zeros((grid, grid), bool)
    a.flat[cells] = True
    return around(around(a, False, np.logical_or.reduce), True, np.logical_and.reduce).ravel()


def merged(routes: list[np.ndarray], o: Options) -> list[tuple[np.ndarray, list[int]]]:
    """Closed maps without repeats: each takes in those after it that overlap it more than ``overlap``, by majority; with the places of its parts."""
    shapes, left, out = [closed(r, o.grid) for r in routes], list(range(len(routes))), []
    while left:
        k = left.pop(0)
        same = [j for j in left if (shapes[k] & shapes[j]).sum() / max(1, (shapes[k] | shapes[j]).sum()) > o.overlap]
        left = [j for j in left if j not in same]
        out.append((np.mean([shapes[i] for i in [k, *same]], axis=0) >= 0.5 if same else shapes[k], [k, *same]))
    return out


def discover(cells: DataFrame, periods: Iterable[int], options: Options | None = None) -> DataFrame:
    """period, key, route, hits, end, cells: the routes of each period, of rows (key, entity, period, cell).

    Periods follow one another, since routes and leftovers carry over. A key with too few maps in a period, those carried over
    among them, has no routes in it: they and its maps wait for the next one. Names of entities should not come again.
    """
    o = options or Options()
    active = carry = out = None
    for period in periods:
        now = maps(cells.filter(F.col("period") == period).drop("period"))
        count = lambda t: t.select("key", "entity").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("total"))
        both = saved(now if carry is None else now.unionByName(carry))
        enough = count(both).filter(F.col("total") >= o.entities).select("key")
        entities = saved(both.join(enough, "key", "left_semi"))
        total, left, found = saved(count(entities)), entities, []
        if active is not None:
            own, new = matched(entities, active, total, o)
            found.append(new.withColumn("rank", F.lit(0)))
            left = saved(left.join(own, ["key", "entity"], "left_anti"))
        searched = count(left).filter(F.col("total") > o.searched * o.entities).select("key")
        pool = saved(left.join(searched, "key", "left_semi"))
        own, new = matched(pool, clustered(pool, o), total, o)
        found.append(new.withColumn("rank", F.lit(1)))
        left = left.join(own, ["key", "entity"], "left_anti")

        every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        routes = every.groupBy("key", "rank", "route", "hits", "end").agg(F.sort_array(F.collect_list("cell")).alias("cells"))  # grid^2 cells, at most

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            """Routes of a key: no more than are active and clusters together."""
            pdf = pdf.sort_values(["rank", "route"])
            rows = [(pdf["key"].iloc[0], n, int(pdf["hits"].iloc[parts].sum()), int(pdf["end"].iloc[parts[0]]), np.flatnonzero(shape).tolist()) for n, (shape, parts) in enumerate(merged([np.array(c, int) for c in pdf["cells"]], o))]
            return pd.DataFrame(rows, columns=["key", "route", "hits", "end", "cells"])

        kept = saved(routes.groupBy("key").applyInPandas(merge, f"key {cells.schema['key'].dataType.simpleString()}, route int, hits long, end long, cells array<long>"))
        new = kept.select("key", "route", F.explode("cells").alias("cell"), F.lit(1.0).alias("w"))
        active = new if active is None else saved(new.unionByName(active.join(enough, "key", "left_anti")))
        waits = both.join(enough, "key", "left_anti")  # too few maps: all of them wait
        order = Window.partitionBy("key").orderBy("entity")
        names = left.select("key", "entity").distinct().withColumn("r", F.row_number().over(order)).filter(F.col("r") <= int(o.entities * o.carried)).select("key", "entity")
        carry = saved(left.join(names, ["key", "entity"], "left_semi").unionByName(waits))
        one = kept.withColumn("period", F.lit(period).cast("long")).select("period", "key", "route", "hits", "end", "cells")
        out = one if out is None else out.unionByName(one)
    return out
