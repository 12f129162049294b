"""Event rules in batch form."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import views as V
from ..operators import aggregates as A
from ..operators import filters as O
from ..registry import query

D = f"WITH {V.DET}"


def one():
    """Counts rows."""
    return F.count(F.lit(1))



def _d(spark, sf_dir):
    return V.detections(spark, sf_dir)


@query("STR1 STR2", f"""WITH {V.EV}, g AS (SELECT user_id, ms, value, event_type, CASE WHEN ms - lag(ms) OVER w <= 21600000 THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ms)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, island::BIGINT AS session, min(ms) AS start, max(ms) AS last, max(ms) + 21600000 AS expires, max(ms) + 216000001 AS purged, count(*) AS n FROM i GROUP BY ALL""")  # fmt: skip
def entity_sessions(spark, sf_dir):
    """Entities by gaps in their events: when each ends, expires, and is purged."""
    i = A.islands(V.events(spark, sf_dir), ["user_id"], "ms", 21600000)
    return i.select("user_id", F.col("island").cast("long").alias("session"), "start", F.col("end").alias("last"), (F.col("end") + 21600000).alias("expires"), (F.col("end") + 216000001).alias("purged"), "n")


@query("STR3", f"{D}, a AS (SELECT seq, id, count(DISTINCT cell // 32) AS rows, avg(score) AS s FROM det GROUP BY ALL) SELECT seq, id, CASE WHEN rows < 24 AND s < 0.45 THEN 'listed' WHEN rows >= 24 THEN 'moving' ELSE 'open' END AS state FROM a")
def blacklist_state(spark, sf_dir):
    a = _d(spark, sf_dir).groupBy("seq", "id").agg(F.countDistinct(F.floor(F.col("cell") / 32)).alias("rows"), F.round(F.avg("score"), 9).alias("s"))  # rounded: the order of a sum must not decide a tie
    return a.select("seq", "id", F.when((F.col("rows") < 24) & (F.col("s") < 0.45), "listed").when(F.col("rows") >= 24, "moving").otherwise("open").alias("state"))


@query("STR4", "SELECT user_id, arg_max(event_type, value * 1000000 + event_id) AS best, count(*) AS offers FROM events GROUP BY user_id")
def attribute_priority(spark, sf_dir):
    """Attribute of highest priority per entity, ties to the later one."""
    return V.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.col("value") * 1000000 + F.col("event_id")).alias("best"), one().alias("offers"))


@query("STR11", f"{D} SELECT seq, id, min(frame) AS frame FROM det WHERE cell < 512 GROUP BY ALL")
def appearance(spark, sf_dir):
    """Once in an entity's life: the first time it is inside the region."""
    return _d(spark, sf_dir).filter("cell < 512").groupBy("seq", "id").agg(F.min("frame").alias("frame"))


@query("STR13", f"{D}, g AS (SELECT seq, id, frame, cell >= 512 AS red, max(CASE WHEN cell < 256 THEN frame END) OVER (PARTITION BY seq, id ORDER BY frame) AS green FROM det) SELECT seq, id, min(frame) AS frame FROM g WHERE red AND green < frame GROUP BY ALL")
def zone_trespassing(spark, sf_dir):
    """First time in the red zone after having been in the green one."""
    green = F.max(F.when(F.col("cell") < 256, F.col("frame"))).over(Window.partitionBy("seq", "id").orderBy("frame"))
    return _d(spark, sf_dir).withColumn("green", green).filter("cell >= 512 and green < frame").groupBy("seq", "id").agg(F.min("frame").alias("frame"))


@query("STR16", f"""{D}, x AS (SELECT seq, id, frame, cell % 32 >= 16 AS side, lag(cell % 32 >= 16) OVER (PARTITION BY seq, id ORDER BY frame) AS was FROM det), c AS (SELECT seq, id, frame, side FROM x WHERE was <> side),
t AS (SELECT *, lag(frame) OVER w AS pf, lag(id) OVER w AS pid FROM c WINDOW w AS (PARTITION BY seq, side ORDER BY frame, id)) SELECT seq, id, frame, pid AS ahead FROM t WHERE pid <> id AND frame - pf <= 1""")  # fmt: skip
def tailgating(spark, sf_dir):
    """A crossing soon after another entity's in the same direction."""
    side = F.col("cell") % 32 >= 16
    c = _d(spark, sf_dir).select("seq", "id", "frame", side.alias("side"), F.lag(side).over(Window.partitionBy("seq", "id").orderBy("frame")).alias("was")).filter("was <> side")
    w = Window.partitionBy("seq", "side").orderBy("frame", "id")
    return c.withColumns({"pf": F.lag("frame").over(w), "ahead": F.lag("id").over(w)}).filter("ahead <> id and frame - pf <= 1").select("seq", "id", "frame", "ahead")


@query("STR17", f"""{D}, z AS (SELECT seq, id, frame, cell // 256 AS zone FROM det), s AS (SELECT a.seq, a.id, a.frame AS f0, (SELECT min(b.frame) FROM z b WHERE b.seq = a.seq AND b.id = a.id AND b.zone = 1 AND b.frame > a.frame) AS f1 FROM z a WHERE zone = 0)
SELECT seq, id, f0, f1, round(100 / (f1 - f0), 6) AS speed FROM s WHERE f1 - f0 <= 12""")  # fmt: skip
def ordered_lines(spark, sf_dir):
    """Zone 0, then zone 1 next, within 12 frames: speed over a known distance."""
    z = _d(spark, sf_dir).withColumn("zone", F.floor(F.col("cell") / 256))
    ahead = Window.partitionBy("seq", "id").orderBy("frame").rowsBetween(1, Window.unboundedFollowing)
    nxt = F.min(F.when(F.col("zone") == 1, F.col("frame"))).over(ahead)
    out = z.withColumn("f1", nxt).filter("zone = 0").select("seq", "id", F.col("frame").alias("f0"), "f1")
    return out.filter("f1 - f0 <= 12").withColumn("speed", F.round(100 / (F.col("f1") - F.col("f0")), 6))


_OCC = f"""{D}, c AS (SELECT seq, frame, coalesce(n, 0) AS n FROM (SELECT seq, unnest(range(1, last + 1)) AS frame FROM (SELECT DISTINCT seq FROM det), (SELECT max(frame) AS last FROM det)) LEFT JOIN (SELECT seq, frame, count(*) AS n FROM det WHERE cell < 512 GROUP BY ALL) USING (seq, frame)),
s AS (SELECT seq, frame, {{cond}} AS on_, row_number() OVER (PARTITION BY seq ORDER BY frame) - row_number() OVER (PARTITION BY seq, {{cond}} ORDER BY frame) AS k FROM c)
SELECT seq, min(frame) AS start, max(frame) AS last FROM s WHERE on_ GROUP BY seq, k HAVING max(frame) - min(frame) + 1 >= {{least}}"""


def _occupied(spark, sf_dir, condition: str, least: int):
    d = _d(spark, sf_dir)
    spine = V.every_frame(d)
    n = d.filter("cell < 512").groupBy("seq", "frame").agg(one().alias("n"))
    c = spine.join(n, ["seq", "frame"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("on", F.expr(condition))
    runs = A.runs_of(c, ["seq"], "frame", "on").filter("`on`")
    return runs.filter(F.col("end") - F.col("start") + 1 >= least).select("seq", "start", F.col("end").alias("last"))


@query("STR20", _OCC.format(cond="n > 1", least=2))
def occupancy(spark, sf_dir):
    """More than one in the region for two frames or longer."""
    return _occupied(spark, sf_dir, "n > 1", 2)


@query("STR21", _OCC.format(cond="n = 0", least=4))
def absence(spark, sf_dir):
    """Nobody in the region for four frames or longer."""
    return _occupied(spark, sf_dir, "n = 0", 4)


@query("STR25", f"""{D}, c AS (SELECT seq, frame // 24 AS win, cell // 32 AS r, cell % 32 AS k, max(score) AS s FROM det GROUP BY ALL), h AS (SELECT * FROM c WHERE s >= 0.3)
SELECT a.seq, a.win, a.r * 32 + a.k AS cell, count(*) AS n FROM h a JOIN h b ON a.seq = b.seq AND a.win = b.win AND abs(a.r - b.r) <= 1 AND abs(a.k - b.k) <= 1 GROUP BY ALL HAVING count(*) >= 2""")  # fmt: skip
def motion_neighbours(spark, sf_dir):
    """Active cells with active neighbours: each cell is dealt to its nine neighbourhoods, so the count is one equi aggregation."""
    r, k = F.floor(F.col("cell") / 32), F.col("cell") % 32
    h = _d(spark, sf_dir).groupBy("seq", F.floor(F.col("frame") / 24).alias("win"), "cell").agg(F.max("score").alias("s")).filter("s >= 0.3")
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    dealt = h.select("seq", "win", r.alias("r"), k.alias("k"), F.explode(near).alias("o")).select("seq", "win", (F.col("r") + F.col("o.i")).alias("r"), (F.col("k") + F.col("o.j")).alias("k"), ((F.col("o.i") == 0) & (F.col("o.j") == 0)).alias("own"))
    n = dealt.groupBy("seq", "win", "r", "k").agg(one().alias("n"), F.max("own").alias("own"))
    return n.filter("own and n >= 2").select("seq", "win", (F.col("r") * 32 + F.col("k")).alias("cell"), "n")


@query("STR27 STR28", f"""WITH {V.EV}, s AS (SELECT user_id, ms, event_id, CASE WHEN value >= 66 THEN 'open' WHEN value < 33 THEN 'closed' ELSE 'unknown' END AS st FROM ev), k AS (SELECT * FROM s WHERE st <> 'unknown'),
c AS (SELECT *, lag(st) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS was FROM k) SELECT event_id, was || '>' || st AS change FROM c WHERE was <> st""")  # fmt: skip
def door_changes(spark, sf_dir):
    """Transitions between open and closed; unknown scores don't interrupt a state."""
    s = F.when(F.col("value") >= 66, "open").when(F.col("value") < 33, "closed")
    k = V.events(spark, sf_dir).withColumn("st", s).filter("st is not null")
    was = F.lag("st").over(Window.partitionBy("user_id").orderBy("ms", "event_id"))
    return k.withColumn("was", was).filter("was <> st").select("event_id", F.concat_ws(">", "was", "st").alias("change"))


@query("STR30", f"""WITH {V.EV}, r AS (SELECT user_id, ms, event_type AS st, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ms, event_id) AS k FROM ev)
SELECT user_id, st AS state, min(ms) AS start, max(ms) AS "end", count(*) AS n FROM r GROUP BY user_id, st, k HAVING count(*) >= 3""")  # fmt: skip
def state_runs(spark, sf_dir):
    """Runs of three or more equal states."""
    e = V.events(spark, sf_dir).withColumn("t", F.struct("ms", "event_id"))
    by = Window.partitionBy("user_id").orderBy("t")
    new = F.when(F.col("event_type").eqNullSafe(F.lag("event_type").over(by)), 0).otherwise(1)
    runs = e.withColumn("new", new).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("user_id", "run", F.col("event_type").alias("state")).agg(F.min("ms").alias("start"), F.max("ms").alias("end"), one().alias("n")).filter("n >= 3").drop("run")


@query("STR48 STR50", f"WITH {V.EV}, b AS (SELECT user_id, ms // 21600000 AS period, min(ms * 100000 + event_id) AS m FROM ev GROUP BY ALL) SELECT user_id, period * 21600000 AS period, m % 100000 AS event_id FROM b")
def period_samples(spark, sf_dir):
    """First sample of each period."""
    e = V.events(spark, sf_dir)
    return e.groupBy("user_id", (F.floor(F.col("ms") / 21600000) * 21600000).alias("period")).agg(F.min_by("event_id", F.struct("ms", "event_id")).alias("event_id"))


@query("STR35", f"""{D}, v AS (SELECT seq, id, frame, count(*) OVER w AS n, count(*) FILTER (score >= 0.5) OVER w AS yes FROM det WINDOW w AS (PARTITION BY seq, id ORDER BY frame RANGE BETWEEN 24 PRECEDING AND CURRENT ROW))
SELECT seq, id, min(frame) AS frame FROM v WHERE n >= 4 AND yes / n >= 0.7 GROUP BY ALL""")  # fmt: skip
def vote_ratio(spark, sf_dir):
    """First time that enough samples of the last 24 frames agree."""
    w = Window.partitionBy("seq", "id").orderBy("frame").rangeBetween(-24, 0)
    v = _d(spark, sf_dir).withColumns({"n": one().over(w), "yes": F.count_if(F.col("score") >= 0.5).over(w)})
    return v.filter("n >= 4 and yes / n >= 0.7").groupBy("seq", "id").agg(F.min("frame").alias("frame"))


@query("STR37 STR40", f"""{D}, a AS (SELECT seq, id, frame, cell, avg(cell) OVER (PARTITION BY seq, id ORDER BY frame ROWS BETWEEN 8 PRECEDING AND 3 PRECEDING) AS long_, avg(cell) OVER (PARTITION BY seq, id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS short_ FROM det)
SELECT seq, id, frame, round(ln((short_ + 1) / (long_ + 1)), 6) AS ratio FROM a WHERE abs(ln((short_ + 1) / (long_ + 1))) > 1""")  # fmt: skip
def two_scale_change(spark, sf_dir):
    """Log ratio of a short mean to the longer one before it."""
    by = Window.partitionBy("seq", "id").orderBy("frame")
    ratio = F.log((F.avg("cell").over(by.rowsBetween(-2, 0)) + 1) / (F.avg("cell").over(by.rowsBetween(-8, -3)) + 1))
    return _d(spark, sf_dir).withColumn("ratio", ratio).filter("abs(ratio) > 1").select("seq", "id", "frame", F.round("ratio", 6).alias("ratio"))


@query("STR38", f"WITH {V.EV}, n AS (SELECT event_id, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW) AS n FROM ev) SELECT event_id, n FROM n WHERE n >= 2")
def count_in_window(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ms").rangeBetween(-86400000, 0)
    return V.events(spark, sf_dir).withColumn("n", F.count_if(F.col("event_type") == "error").over(w)).filter("n >= 2").select("event_id", "n")


@query("STR39", f"""{D}, p AS (SELECT seq, id, frame, lead(frame) OVER (PARTITION BY seq, id ORDER BY frame) AS nxt FROM det) SELECT seq, id, frame + 36 AS frame, nxt IS NOT NULL AS returned FROM p WHERE nxt - frame > 36 OR (nxt IS NULL AND frame + 36 <= (SELECT max(frame) FROM det))""")
def missing_object(spark, sf_dir):
    """Suspected gone after 36 frames unseen; whether it returned later."""
    d = _d(spark, sf_dir)
    p = d.withColumn("last", d.agg(F.max("frame")).scalar()).withColumn("nxt", F.lead("frame").over(Window.partitionBy("seq", "id").orderBy("frame")))
    gone = p.filter("nxt - frame > 36 or (nxt is null and frame + 36 <= last)")
    return gone.select("seq", "id", (F.col("frame") + 36).alias("frame"), F.col("nxt").isNotNull().alias("returned"))


@query("STR42 STR8", f"WITH {V.EV}, s AS (SELECT user_id, event_type, min(ms) AS first, max(ms) AS last, count(*) AS n FROM ev WHERE value >= 50 GROUP BY ALL), l AS (SELECT DISTINCT user_id FROM ev WHERE event_type = 'purchase' AND value > 90) SELECT s.user_id, event_type, first, first + 10000 AS decided, l.user_id IS NOT NULL AS known, n FROM s LEFT JOIN l USING (user_id)")
def recognition(spark, sf_dir):
    """Each entity and kind once, decided ten seconds after it was first seen, known if it is on the list."""
    e = V.events(spark, sf_dir)
    listed = e.filter("event_type = 'purchase' and value > 90").select("user_id").distinct().withColumn("known", F.lit(True))
    s = e.filter("value >= 50").groupBy("user_id", "event_type").agg(F.min("ms").alias("first"), one().alias("n"))
    return s.join(listed, "user_id", "left").select("user_id", "event_type", "first", (F.col("first") + 10000).alias("decided"), F.coalesce("known", F.lit(False)).alias("known"), "n")


@query("STR9 JN30", f"{D}, h AS (SELECT *, lag(frame) OVER (PARTITION BY seq, cell // 64 ORDER BY frame, id) AS pf, lag(id) OVER (PARTITION BY seq, cell // 64 ORDER BY frame, id) AS pid FROM det) SELECT seq, frame, id, coalesce(frame - pf <= 3 AND pid = id, false) AS seen_before FROM h WHERE score >= 0.3")
def history_match(spark, sf_dir):
    """Whether the last entity seen at a place is the same and recent."""
    w = Window.partitionBy("seq", F.floor(F.col("cell") / 64)).orderBy("frame", "id")
    h = _d(spark, sf_dir).withColumns({"pf": F.lag("frame").over(w), "pid": F.lag("id").over(w)}).filter("score >= 0.3")
    return h.select("seq", "frame", "id", F.coalesce((F.col("frame") - F.col("pf") <= 3) & (F.col("pid") == F.col("id")), F.lit(False)).alias("seen_before"))


@query("STR26", f"""WITH RECURSIVE {V.EV}, e AS (SELECT user_id % 8 AS camera, ms FROM ev GROUP BY ALL), a AS (SELECT camera, min(ms) AS ms FROM e GROUP BY camera
  UNION ALL SELECT a.camera, (SELECT min(e.ms) FROM e WHERE e.camera = a.camera AND e.ms >= a.ms + 3600000) FROM a WHERE a.ms IS NOT NULL) SELECT camera, ms FROM a WHERE ms IS NOT NULL""")  # fmt: skip
def periodic_snapshots(spark, sf_dir):
    """Snapshots at least an hour apart, each counted from the last taken."""
    e = V.events(spark, sf_dir).select((F.col("user_id") % 8).alias("camera"), "ms").distinct()
    return O.spaced(e, ["camera"], "ms", 3600000)


@query("STR45", f"WITH {V.EV} SELECT user_id % 8 AS camera, (ms + 1799999) // 1800000 * 1800000 AS period, count(*) AS n, round(avg(value), 5) AS mean, arg_max(value, ms * 100000 + event_id) AS latest FROM ev GROUP BY ALL")
def variable_sync(spark, sf_dir):
    """Half-hour periods that end at the next full half hour."""
    end = F.ceil(F.col("ms") / 1800000) * 1800000
    return V.events(spark, sf_dir).groupBy((F.col("user_id") % 8).alias("camera"), end.alias("period")).agg(one().alias("n"), F.round(F.avg("value"), 5).alias("mean"), F.max_by("value", F.struct("ms", "event_id")).alias("latest"))
