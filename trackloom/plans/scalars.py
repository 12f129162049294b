"""Scalar functions applied to whole tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .. import views as V
from ..functions import boxes as B
from ..functions import geometry as G
from ..functions import text as T
from ..registry import query

D = f"WITH {V.DET}"


@query("SCL1 RET12", f"{D} SELECT seq, frame, id, x + w / 2 AS cx, y + h / 2 AS cy, round(w / h, 6) AS aspect, w * h AS area, round((x + w / 2) - sqrt(w * h * (w / h)) / 2, 6) AS back_left, least(1, greatest(0, x / 900)) AS clipped FROM det")
def box_conversions(spark, sf_dir):
    x, y, w, h = (F.col(c) for c in "xywh")
    u, v, s, r = B.to_state(x, y, w, h)
    back = B.from_state(u, v, s, r)
    return V.detections(spark, sf_dir).select("seq", "frame", "id", u.alias("cx"), v.alias("cy"), F.round(r, 6).alias("aspect"), s.alias("area"), F.round(back[0], 6).alias("back_left"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / 900)).alias("clipped"))


@query("SCL3", f"{D}, c AS (SELECT seq, cell // 32 AS row, cell % 32 AS col FROM det) SELECT seq, row, sum(DISTINCT 1::BIGINT << col)::BIGINT AS bits FROM c GROUP BY ALL")
def roi_bitmap(spark, sf_dir):
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("cell") % 32).cast("int"))
    return V.detections(spark, sf_dir).groupBy("seq", F.floor(F.col("cell") / 32).alias("row")).agg(F.bit_or(bit).alias("bits"))


@query("SCL4", f"""{D}, s AS (SELECT *, ['left', 'right', 'top', 'bottom', 'centre'][cls + 1] AS side FROM det)
SELECT seq, frame, id, CASE side WHEN 'left' THEN x WHEN 'right' THEN x + w ELSE x + w / 2 END AS px, CASE side WHEN 'top' THEN y WHEN 'bottom' THEN y + h ELSE y + h / 2 END AS py FROM s""")  # fmt: skip
def reference_points(spark, sf_dir):
    side = F.element_at(F.array(*[F.lit(s) for s in ("left", "right", "top", "bottom", "centre")]), (F.col("cls") + 1).cast("int"))
    px, py = G.reference_point(*(F.col(c) for c in "xywh"), side)
    return V.detections(spark, sf_dir).select("seq", "frame", "id", px.alias("px"), py.alias("py"))


@query("SCL5 WIN5", f"""{D}, p AS (SELECT seq, id, frame, lag(cell % 32) OVER w AS px, lag(cell // 32) OVER w AS py, cell % 32 AS qx, cell // 32 AS qy FROM det WINDOW w AS (PARTITION BY seq, id ORDER BY frame)),
s AS (SELECT *, sign(10 * (py - 5) - 20 * (px - 10)) AS d1, sign(10 * (qy - 5) - 20 * (qx - 10)) AS d2, sign((qx - px) * (5 - py) - (qy - py) * (10 - px)) AS d3, sign((qx - px) * (25 - py) - (qy - py) * (20 - px)) AS d4 FROM p WHERE px IS NOT NULL),
t AS (SELECT *, (d1 = 0 AND px BETWEEN 10 AND 20 AND py BETWEEN 5 AND 25) OR (d2 = 0 AND qx BETWEEN 10 AND 20 AND qy BETWEEN 5 AND 25) OR (d3 = 0 AND 10 BETWEEN least(px, qx) AND greatest(px, qx) AND 5 BETWEEN least(py, qy) AND greatest(py, qy))
  OR (d4 = 0 AND 20 BETWEEN least(px, qx) AND greatest(px, qx) AND 25 BETWEEN least(py, qy) AND greatest(py, qy)) AS touch FROM s)
SELECT seq, id, frame, CASE WHEN (d1 <> d2 AND d3 <> d4) OR touch THEN CASE WHEN d1 <> 0 THEN d1 ELSE -d2 END ELSE 0 END::INT AS direction FROM t""")  # fmt: skip
def segment_crossings(spark, sf_dir):
    from pyspark.sql import Window

    by = Window.partitionBy("seq", "id").orderBy("frame")
    x, y = F.col("cell") % 32, F.floor(F.col("cell") / 32)
    p = V.detections(spark, sf_dir).select("seq", "id", "frame", F.lag(x).over(by).alias("px"), F.lag(y).over(by).alias("py"), x.alias("qx"), y.alias("qy")).filter("px is not null")
    a, b = (F.lit(10), F.lit(5)), (F.lit(20), F.lit(25))
    return p.select("seq", "id", "frame", G.crossing((F.col("px"), F.col("py")), (F.col("qx"), F.col("qy")), a, b).alias("direction"))


@query("SCL6", f"{D}, p AS (SELECT seq, frame, id, ((cell % 32 - 2) * 20 + (cell // 32 - 3) * 10) / 500.0 AS t FROM det) SELECT seq, frame, id, round(t, 6) AS t, round(2 + 20 * least(1, greatest(0, t)), 6) AS nx FROM p")
def lane_projection(spark, sf_dir):
    """Where a position falls along the lane from (2, 3) to (22, 13), and the nearest point's x."""
    t = ((F.col("cell") % 32 - 2) * 20 + (F.floor(F.col("cell") / 32) - 3) * 10) / 500.0
    return V.detections(spark, sf_dir).select("seq", "frame", "id", F.round(t, 6).alias("t"), F.round(2 + 20 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)), 6).alias("nx"))


@query("SCL7", f"""{D}, m AS (SELECT seq, id, var_samp(cell % 32) AS sx, var_samp(cell // 32) AS sy, covar_samp(cell % 32, cell // 32) AS c FROM det GROUP BY ALL HAVING count(*) > 20)
SELECT seq, id, round(degrees(atan2(2 * c, sx - sy)) / 2, 4) AS angle, round((sx + sy + sqrt((sx - sy) ** 2 + 4 * c * c)) / 2 / (sx + sy), 5) AS explained FROM m""")  # fmt: skip
def lane_fit(spark, sf_dir):
    angle, share = G.principal_axis(F.col("cell") % 32, F.floor(F.col("cell") / 32))
    out = V.detections(spark, sf_dir).groupBy("seq", "id").agg(F.round(angle, 4).alias("angle"), F.round(share, 5).alias("explained"), F.count(F.lit(1)).alias("n"))
    return out.filter("n > 20").drop("n")


@query("SCL8", f"{D}, p AS (SELECT seq, frame, id, cell % 32 + 0.5 AS x, cell // 32 + 0.5 AS y FROM det) SELECT seq, frame, id FROM p WHERE (((4 > y) <> (4 > y)) AND false) <> ((4 > y) <> (28 > y) AND x < (16 - 28) * (y - 4) / 24 + 28) AND NOT ((28 > y) <> (4 > y) AND x < (4 - 16) * (y - 28) / (4 - 28) + 16)")
def in_triangle(spark, sf_dir):
    """Cell centres inside the triangle (4, 4), (28, 4), (16, 28)."""
    p = (F.col("cell") % 32 + 0.5, F.floor(F.col("cell") / 32) + 0.5)
    return V.detections(spark, sf_dir).filter(G.in_polygon(p, [(4, 4), (28, 4), (16, 28)])).select("seq", "frame", "id")


@query("SCL9")
def plate_weighted_distance(spark, sf_dir):
    """Edit distance with cheap confusions of a name and the part's brand; an Arrow UDF, since substitution costs vary."""
    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([T.weighted_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    p = V.table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(distance(F.upper("p_name"), F.upper("p_brand")), 4).alias("distance"))


@query("SCL10", "WITH t AS (SELECT event_id, strftime(ts, '%I:%M %p') AS t, hour(ts) * 60 + minute(ts) AS m FROM events) SELECT event_id, m AS opens, CASE WHEN m = 0 THEN 1440 ELSE m END AS closes FROM t")
def clock_times(spark, sf_dir):
    t = V.table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "hh:mm a").alias("t"))
    return t.select("event_id", T.clock24(F.col("t"), False).cast("long").alias("opens"), T.clock24(F.col("t"), True).cast("long").alias("closes"))


@query("SCL11", "SELECT event_id, floor(value)::BIGINT * CASE user_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 ELSE 86400 END AS seconds FROM events")
def duration_units(spark, sf_dir):
    unit = F.create_map(*[F.lit(x) for kv in ((0, 1), (1, 60), (2, 3600), (3, 86400)) for x in kv])
    return V.table(spark, sf_dir, "events").select("event_id", (F.floor("value") * unit[(F.col("user_id") % 4).cast("int")]).alias("seconds"))


@query("SCL12", "SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 6) AS p, round(exp(value / 100) / (exp(value / 100) + exp(1.0) + exp(0.5)), 6) AS s FROM events")
def sigmoid_softmax(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").withColumn("v", F.transform(F.array(F.col("value") / 100, F.lit(1.0), F.lit(0.5)), lambda x: F.exp(x)))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return e.select("event_id", F.round(1 / (1 + F.exp(-(F.col("value") - 50) / 10)), 6).alias("p"), F.round(F.col("v")[0] / total, 6).alias("s"))


@query("SCL18", "SELECT doc_id, md5(text) AS code, base64(encode(text)) AS packed, text AS back FROM documents")
def encode_payload(spark, sf_dir):
    """Whole texts to base64, in one line, and back."""
    d = V.table(spark, sf_dir, "documents")
    packed = F.translate(F.base64(F.encode("text", "UTF-8")), "\r\n", "")
    return d.select("doc_id", F.lower(F.hex(F.unhex(F.md5("text")))).alias("code"), packed.alias("packed"), F.decode(F.unbase64(packed), "UTF-8").alias("back"))


@query("SCL13")
def vector_hex(spark, sf_dir):
    """Whole vectors as hex of their little-endian floats, and back; an Arrow UDF."""
    @F.pandas_udf("string")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes().hex())

    @F.pandas_udf("array<float>")
    def unpack(h: pd.Series) -> pd.Series:
        return h.map(lambda x: None if x is None else np.frombuffer(bytes.fromhex(x), "<f4"))

    e = V.table(spark, sf_dir, "embeddings").withColumn("code", pack("embedding"))
    return e.select("vec_id", "code", unpack("code").alias("back"))


@query("SCL14", """SELECT o_orderkey, left(sha256('{"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}'), 16) AS hash FROM orders""")
def config_hash(spark, sf_dir):
    c = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    return V.table(spark, sf_dir, "orders").select("o_orderkey", T.config_hash(c).alias("hash"))


@query("SCL15 SCL16", "SELECT p_partkey, regexp_replace(p_type || '/' || p_brand, '[^0-9A-Za-z._-]', '_', 'g') AS path, p_brand || CASE WHEN p_size % 3 <> 0 THEN '_fps' || CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE CAST(p_size // 2 AS VARCHAR) || 'p5' END ELSE '' END AS run FROM part")
def safe_names(spark, sf_dir):
    fps = F.when(F.col("p_size") % 3 != 0, F.col("p_size") / 2.0)
    return V.table(spark, sf_dir, "part").select("p_partkey", T.safe_component(F.concat_ws("/", "p_type", "p_brand")).alias("path"), T.run_id(F.col("p_brand"), fps=fps).alias("run"))


@query("SCL17 SNK12", """WITH s AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS v, CAST(o_custkey * 7 AS BIGINT) AS s FROM orders)
SELECT o_orderkey, format('{:,}', v) AS thousands, printf('%.3f', v / 8) AS decimals, CASE WHEN s >= 3600 THEN printf('%dh%02dm%02ds', s // 3600, s // 60 % 60, s % 60) WHEN s >= 60 THEN printf('%dm%02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS took,
  printf('CEF:0|%d|%s', o_orderkey % 8, 'order') AS cef FROM s""")  # fmt: skip
def formats(spark, sf_dir):
    v = F.floor("o_totalprice")
    cef = F.format_string("CEF:0|%d|%s", F.col("o_orderkey") % 8, F.lit("order"))
    return V.table(spark, sf_dir, "orders").select("o_orderkey", F.format_number(v, 0).alias("thousands"), F.format_string("%.3f", v / 8).alias("decimals"), T.duration(F.col("o_custkey") * 7).alias("took"), cef.alias("cef"))


@query("SCL19 SCL20", f"""{D}, r AS (SELECT seq, id, list_distinct(list(cell // 16)) AS cells FROM det GROUP BY ALL)
SELECT a.seq, a.id AS a, b.id AS b, round(len(list_intersect(a.cells, b.cells)) / len(list_distinct(list_concat(a.cells, b.cells))), 6) AS sim FROM r a JOIN r b ON a.seq = b.seq AND a.id < b.id""")  # fmt: skip
def route_similarity(spark, sf_dir):
    """Share of cells that two routes of a sequence have in common."""
    cell = F.floor(F.col("cell") / 16)  # from -63 to 63, so a route is the bits of two words
    word = lambda inside: F.coalesce(F.bit_or(F.when(inside, F.call_function("shiftleft", F.lit(1).cast("long"), (cell % 64 + 64).cast("int") % 64))), F.lit(0).cast("long"))
    r = V.detections(spark, sf_dir).groupBy("seq", "id").agg(word(cell >= 0).alias("u"), word(cell < 0).alias("v"))
    # Sequences are few: each is dealt to as many tasks as there are partitions.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = r.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(tasks)).cast("int")).repartition(tasks, "seq", "part")
    all_ = r.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartition(tasks, "seq", "part")
    both = own.alias("a").join(all_.hint("merge").alias("b"), (F.col("a.seq") == F.col("b.seq")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.id") < F.col("b.id")))
    bits = lambda with_: F.bit_count(with_("u")) + F.bit_count(with_("v"))
    sim = bits(lambda w: F.col(f"a.{w}").bitwiseAND(F.col(f"b.{w}"))) / bits(lambda w: F.col(f"a.{w}").bitwiseOR(F.col(f"b.{w}")))
    # Half up, as F.round does, but without a decimal for each pair: both numbers are below 128, so no product is off by enough to matter.
    return both.select("a.seq", F.col("a.id").alias("a"), F.col("b.id").alias("b"), (F.floor(sim * 1e6 + 0.5) / 1e6).alias("sim"))


@query("SCL21 SNK10 SNK11", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'type=' || event_type || CASE WHEN value >= 80 THEN ';level=HIGH' ELSE '' END AS attrs FROM events")
def json_attributes(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    found = F.from_json("props", "k bigint")
    listed = F.filter(F.array(F.struct(F.lit("type").alias("n"), F.col("event_type").alias("v"), F.lit(True).alias("ok")), F.struct(F.lit("level").alias("n"), F.lit("HIGH").alias("v"), (F.col("value") >= 80).alias("ok"))), lambda a: a["ok"])
    return e.select("event_id", found["k"].alias("k"), F.array_join(F.transform(listed, lambda a: F.concat(a["n"], F.lit("="), a["v"])), ";").alias("attrs"))
