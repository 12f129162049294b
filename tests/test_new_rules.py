"""Polygon joins, routes, the entity registry, micro-tracks, monitors and masks against brute force."""

import math
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom import registry
from trackloom import views as V
from trackloom.functions import masks as M
from trackloom.metrics import boundaries as B
from trackloom.operators import microtracks, monitors, polygons, routes
from trackloom.plans import lifecycles as L
from trackloom.streaming import entities as E

SF = "/root/testdata/sf0.001"
registry.load()


def clipped(poly, l, t, r, b):
    """Sutherland-Hodgman."""
    for inside, cut in (
        (lambda p: p[0] >= l, lambda p, q: (l, p[1] + (l - p[0]) * (q[1] - p[1]) / (q[0] - p[0]))), (lambda p: p[0] <= r, lambda p, q: (r, p[1] + (r - p[0]) * (q[1] - p[1]) / (q[0] - p[0]))),
        (lambda p: p[1] >= t, lambda p, q: (p[0] + (t - p[1]) * (q[0] - p[0]) / (q[1] - p[1]), t)), (lambda p: p[1] <= b, lambda p, q: (p[0] + (b - p[1]) * (q[0] - p[0]) / (q[1] - p[1]), b)),
    ):
        out = []
        for p, q in zip(poly, poly[1:] + poly[:1], strict=True):
            if inside(p):
                out.append(p)
            if inside(p) != inside(q):
                out.append(cut(p, q))
        poly = out
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(poly, poly[1:] + poly[:1], strict=True))) / 2 if poly else 0.0


@pytest.mark.parametrize("cell", [7.0, 1000.0])
def test_polygons_on_boxes_equal_clipping(spark, cell):
    rng = np.random.default_rng(2)
    star = lambda cx, cy: [(cx + r * math.cos(a), cy + r * math.sin(a)) for a, r in zip(np.linspace(0, 2 * np.pi, 9)[:-1].tolist(), rng.uniform(3, 25, 8).tolist(), strict=True)]
    shapes = [(int(k % 2), k, star(*rng.uniform(-40, 60, 2).tolist())) for k in range(14)] + [(0, 90, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]), (0, 91, [(0.0, 0.0), (5.0, 5.0)]), (1, 92, [])]
    boxes = [(int(k % 2), k, *rng.uniform(-50, 50, 2).tolist(), *rng.uniform(0, 30, 2).tolist()) for k in range(60)] + [(0, 200, 0.0, 0.0, 10.0, 10.0), (0, 201, 3.0, 3.0, 0.0, 4.0)]
    p = spark.createDataFrame(shapes, "seq int, polygon int, vertices array<struct<x:double,y:double>>")
    b = spark.createDataFrame(boxes, "seq int, id int, x double, y double, w double, h double")
    for of in ("box", "polygon"):
        got = {(r.id, r.polygon): r for r in polygons.polygons_on_boxes(p, b, ["seq"], cell, 0.05, of).collect()}
        n = polygons.polygons_on_boxes(p, b, ["seq"], cell, 0.05, of).count()
        want = {}
        for s, k, v in shapes:
            whole = abs(sum(a[0] * c[1] - c[0] * a[1] for a, c in zip(v, v[1:] + v[:1], strict=True))) / 2
            for t, i, x, y, w, h in boxes:
                size = w * h if of == "box" else whole
                if s == t and whole and w * h and (c := clipped(v, x, y, x + w, y + h)) > 0.05 * size:
                    want[i, k] = c
        assert set(got) == set(want) and n == len(want) and all(abs(got[k].common - c) < 1e-6 for k, c in want.items())
        assert of == "polygon" or got[200, 90].share == 1.0


def plain_routes(cells, periods, o, seeds):
    """One key's routes, with dense maps. seeds: entities by the order in which k-means takes them."""
    size, active, carry, waiting, out = o.grid**2, [], {}, {}, {}

    def match(maps, lines, total):
        hits, own = defaultdict(list), set()
        for e in sorted(maps):
            cos = [round(float(maps[e] @ r / (np.linalg.norm(maps[e]) * np.linalg.norm(r))), 9) for r in lines]
            if cos and max(cos) > o.match:
                hits[cos.index(max(cos))].append(e)
        new = []
        for k in sorted(hits):
            if len(hits[k]) >= o.percent / 100 * total:
                own |= set(hits[k])
                shape = np.sum([maps[e] > 0 for e in hits[k]], axis=0) > 1
                if shape.any():
                    new.append((len(hits[k]), np.flatnonzero(shape), int(np.argmax(np.round(np.sum([maps[e] for e in hits[k]], axis=0), 9)))))
        return own, new

    for period in periods:
        n = defaultdict(Counter)
        for e, p, c in cells:
            if p == period:
                n[e][c] += 1
        for e, counts in n.items():
            m = np.zeros(size)
            for c, k in counts.items():
                m[c] = k / max(counts.values())
            waiting[e] = m
        waiting |= carry
        if len(waiting) < o.entities:
            carry = dict(waiting)
            waiting = {}
            continue
        maps, waiting, carry = waiting, {}, {}
        total = len(maps)
        own, found = match(maps, active, total)
        left = {e: m for e, m in maps.items() if e not in own}
        if len(left) > o.searched * o.entities:
            centres = [left[e].copy() for e in sorted(left, key=lambda e: (seeds[e], e))[: o.clusters]]
            for _ in range(o.rounds):
                of = {e: min((round(float(m @ m + c @ c - 2 * (m @ c)), 9), k) for k, c in enumerate(centres))[1] for e, m in left.items()}
                centres = [np.mean([left[e] for e in sorted(of) if of[e] == k], axis=0) if k in of.values() else c for k, c in enumerate(centres)]
            own, new = match(left, centres, total)
            found += new
            left = {e: m for e, m in left.items() if e not in own}
        merged = routes.merged([c for _, c, _ in found], o)
        out[period] = [(sum(found[i][0] for i in parts), found[parts[0]][2], np.flatnonzero(s).tolist()) for s, parts in merged]
        active = [s.astype(float) for s, _ in merged]
        carry = {e: left[e] for e in sorted(left)[: int(o.entities * o.carried)]}
    return out


def test_routes_equal_dense_maps(spark):
    rng = np.random.default_rng(9)
    o = routes.Options(grid=8, entities=12, match=0.7, percent=10.0, clusters=3, rounds=3)
    lines = [[8 * r + c for c in range(8)] for r in (1, 4)] + [[8 * r + 5 for r in range(8)]]
    rows = []
    for period in range(3):
        for e in range(24 if period != 1 else 9):
            line = lines[int(rng.integers(0, 3))] if period == 0 or e % 4 else rng.integers(0, 64, 8).tolist()
            rows += [(100 * period + e, period, int(c)) for c in line for _ in range(int(rng.integers(0, 3)))]
    df = spark.createDataFrame([(k, *r) for k in ("a", "b") for r in rows if k == "a" or r[0] % 2], "key string, entity long, period long, cell long")
    seeds = {r.entity: r.h for r in df.select("entity", F.xxhash64("entity", F.lit(o.seed)).alias("h")).distinct().collect()}
    got = defaultdict(lambda: defaultdict(list))
    for r in sorted(routes.discover(df, range(3), o).collect(), key=lambda r: r.route):
        got[r.key][r.period].append((r.hits, r.end, r.cells))
    for k in ("a", "b"):
        want = {p: v for p, v in plain_routes([r for r in rows if k == "a" or r[0] % 2], range(3), o, seeds).items() if v}
        assert got[k] == want and want


def test_closing_keeps_the_border():
    grid = np.zeros((6, 6), bool)
    grid[0, :3], grid[2, 2], grid[4, 5] = True, True, True
    got = routes.closed(np.flatnonzero(grid.ravel()), 6).reshape(6, 6)
    assert got[grid].all() and got[1, 2] and not got[5, 0]


def plain_registry(rows, o):
    """Entities by scanning all of them before each sighting."""
    live, places, out = {}, {}, []

    def expire(until):
        while True:
            due = sorted((e["last"] + (o.gap if e["on"] else o.keep * o.gap) + 1, i) for i, e in live.items())
            if not due or due[0][0] > until:
                return
            at, i = due[0]
            e = live[i]
            if not e["on"]:
                out.append((at, i, "purged", e["cls"], e["listed"]))
                del live[i]
                continue
            e["on"] = False
            conf = [c for c, _ in e["seen"]]
            if e["listed"] or (sum(conf) / len(conf) <= o.confidence and span(e) <= o.span):
                e["listed"] = True
                forget(at)
                if not any(c == e["cls"] and E.iou(b, e["box"]) > o.same for c, _, b in places.values()):
                    places[i] = (e["cls"], e["last"], e["box"])
            out.append((at, i, "removed", e["cls"], e["listed"]))

    def forget(at):
        for k in [k for k, p in places.items() if p[1] + o.listed_for < at]:
            del places[k]

    def span(e):
        x, y = [[(b[k] + b[k + 2] / 2) for _, b in e["seen"]] for k in (0, 1)]
        return max(max(x) - min(x), max(y) - min(y))

    for ms, i, cls, conf, *box in rows:
        box = tuple(box)
        expire(ms)
        if i not in live:
            forget(ms)
            listed = conf < o.confidence or any(c == cls and E.iou(b, box) > o.place for c, _, b in places.values())
            live[i] = {"last": ms, "on": True, "listed": listed, "cls": cls, "seen": [(conf, box)], "kinds": [cls], "box": box}
            out.append((ms, i, "created", cls, listed))
            continue
        e = live[i]
        if not e["on"]:
            e["on"] = True
            out.append((ms, i, "reactivated", e["cls"], e["listed"]))
        before = span(e)
        e["seen"].append((conf, box))
        e["kinds"].append(cls)
        e["last"], e["box"] = ms, box
        votes = Counter(e["kinds"])
        most = max(votes, key=lambda c: (votes[c], -c))
        if votes[most] > votes[e["cls"]]:
            e["cls"] = most
            out.append((ms, i, "changed", e["cls"], e["listed"]))
        xs, ys = [[(b[k] + b[k + 2] / 2) for _, b in e["seen"]] for k in (0, 1)]
        moved = xs[-1] in (min(xs), max(xs)) and xs[-1] not in xs[:-1] or ys[-1] in (min(ys), max(ys)) and ys[-1] not in ys[:-1]
        if e["listed"] and moved and span(e) >= before and span(e) > o.span * (1 if max(c for c, _ in e["seen"]) > o.confidence else 2):
            e["listed"] = False
            out.append((ms, i, "unlisted", e["cls"], False))
    return out


def test_registry_equals_a_plain_scan(spark):
    by = defaultdict(list)
    for r in L.sightings(spark, SF).collect():
        by[r.seq].append(tuple(r)[1:])
    got = defaultdict(list)
    for r in registry.QUERIES["entity_registry"](spark, SF).collect():
        got[r.seq].append(tuple(r)[1:])
    assert set(got) == set(by)
    for seq, rows in by.items():
        assert sorted(got[seq]) == sorted(plain_registry(sorted(rows), L.ENTITIES)), seq
    assert {e for rows in got.values() for _, _, e, _, _ in rows} == {"created", "changed", "removed", "reactivated", "purged", "unlisted"}


def test_registry_stream_equals_the_table(spark, tmp_path):
    """Three files, rows out of order within the lateness, one too late; a last row moves the watermark past all timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = np.random.default_rng(4)
    o = E.Options(gap=2000, keep=3, confidence=0.5, span=20.0, place=0.6, listed_for=20_000)
    base = 1_700_000_000_000
    rows = sorted({(int(t), int(i)): (f"c{i % 2}", base + int(t), int(i), int(i % 3 if t % 5 else 1), float(rng.choice([0.3, 0.9])), float(i * 40 + (t / 300 if i % 2 else 0)), 0.0, 30.0, 30.0) for t, i in zip(rng.integers(0, 30_000, 160), rng.integers(0, 9, 160), strict=True)}.values(), key=lambda r: r[1])
    schema = "cam string, ms long, id long, cls long, conf double, x double, y double, w double, h double"
    path = f"{tmp_path}/in"
    parts = [rows[:60], rows[60:110], rows[110:]]
    parts = [[p[k] for k in rng.permutation(len(p))] for p in parts]
    parts[2].append(("c0", base + 1, 77, 1, 0.9, 0.0, 0.0, 9.0, 9.0))  # long past the watermark
    end = [(c, base + 10**6, 99, 0, 0.9, 0.0, 500.0, 9.0, 9.0) for c in ("c0", "c1")]
    for k, part in enumerate([*parts, end]):
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_millis("ms")).drop("ms").coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    s = spark.readStream.schema("cam string, id long, cls long, conf double, x double, y double, w double, h double, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    q = E.registry_stream(s, "cam", "5 seconds", o).writeStream.outputMode("append").format("memory").queryName("entities").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
    assert q.awaitTermination(150)
    got = Counter(tuple(r) for r in spark.table("entities").collect() if r.id != 99)
    table = spark.createDataFrame([*rows, *end], schema)
    want = Counter(tuple(r) for r in E.registry(table, "cam", o).collect() if r.id != 99)
    assert got == want and {"purged", "reactivated", "unlisted"} <= {r[3] for r in want}


def plain_tracks(rows, o):
    """Micro-tracks of one sequence, without arrays."""
    tracks, ignored, out = [], [], []
    mean = lambda v: sum(v) / len(v)

    def place(t):
        c = [s[1] for s in t["seen"]]
        m = (mean([p[0] for p in c]), mean([p[1] for p in c]))
        return m, statistics.pstdev([math.dist(p, m) for p in c])

    def ignore(t):
        if t["on"] and mean([s[2] for s in t["seen"]]) < o.ignored_confidence and place(t)[1] < o.ignored_spread:
            m, last = place(t)[0], t["seen"][-1][0]
            for p in ignored:
                if math.dist(p[0], m) < o.ignored_near:
                    p[:] = [m, last]
                    return
            ignored.append([m, last])

    def clean(now):
        for t in list(tracks):
            if t["seen"][-1][0] <= now - o.hold:
                ignore(t)
                tracks.remove(t)
            else:
                t["seen"] = t["seen"][-o.latency :]
        ignored[:] = [p for p in ignored if p[1] > now - o.ignored_for]

    frames = defaultdict(list)
    for r in rows:
        frames[r[0]].append(r[1:])
    for now in sorted(frames):
        clean(now - 1)
        dets = sorted((d for d in frames[now] if d[0] > o.confidence), key=lambda d: (-d[0], d[2:], d[1]))
        for k, (conf, vote, x, y, w, h) in enumerate(dets):
            over = lambda a: max(0, min(a[2] + a[4], x + w) - max(a[2], x)) * max(0, min(a[3] + a[5], y + h) - max(a[3], y)) / min(a[4] * a[5], w * h)
            if any(over(a) > 0.001 for a in dets[:k]):
                continue
            c = (x + w / 2, y + h / 2)
            near = [t for t in sorted(tracks, key=lambda t: math.dist(c, t["seen"][-1][1])) if math.dist(c, t["seen"][-1][1]) < o.near and t["seen"][-1][0] < now]
            if near:
                near[0]["seen"].append((now, c, conf, vote))
                near[0]["n"] += 1
            else:
                tracks.append({"seen": [(now, c, conf, vote)], "on": True, "n": 1})
        for t in tracks:
            if not t["on"]:
                t["seen"] = t["seen"][-1:]
            elif len(t["seen"]) >= o.latency and t["seen"][-1][0] == now:
                m, spread = place(t)
                known = [p for p in ignored if math.dist(p[0], m) < o.ignored_near]
                if statistics.median([s[2] for s in t["seen"]]) < o.ignored_confidence and spread < o.ignored_spread and known:
                    known[0][1], t["on"] = now, False
                    continue
                votes = sum(s[3] for s in t["seen"][-o.latency :])
                if votes >= o.ratio * o.latency:
                    out.append((now, *t["seen"][-1][1], t["seen"][-1][2], t["n"], votes))
                    ignore(t)
                    t["on"], t["seen"] = False, t["seen"][-1:]
        clean(now)
    return out


def test_rare_appearances_equal_a_plain_fold(spark):
    for o in (L.HAZARDS, microtracks.Options(confidence=0.0, near=30.0, latency=2, ratio=0.5, hold=40, ignored_confidence=0.9, ignored_spread=9.0, ignored_near=25.0, ignored_for=90)):
        by = defaultdict(list)
        for r in L.hazards(spark, SF).collect():
            by[r.seq].append(tuple(r)[1:])
        got = defaultdict(list)
        for r in microtracks.rare_appearances(L.hazards(spark, SF), "seq", o).collect():
            got[r.seq].append(tuple(r)[1:])
        want = {k: plain_tracks(v, o) for k, v in by.items()}
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}
    assert sum(map(len, want.values())) > 10


def test_sampler_follows_agreement(spark):
    o = monitors.Sampler(period=10, longest=100, latency=3, valid=2, motion=5.0)
    rows = [(t, "a", 9.0) for t in range(0, 40, 10)] + [(45, "b", 0.0), (50, "b", 0.0), (55, "b", 9.0), (60, "b", 0.0), (65, "b", 0.0), (70, "a", 0.0), (160, "a", 0.0), (200, "b", 9.0)]
    df = spark.createDataFrame([("k", t, i, s, m) for i, (t, s, m) in enumerate(rows)], "k string, ms long, event long, state string, motion double")
    got = [(r.ms, r.denoised, r.changed_at, r.was, r.lasted) for r in monitors.sampled(df, "k", "event", o).orderBy("ms").collect()]
    # Dense until three agree; then only with motion or after the longest wait.
    assert got == [(0, None, None, None, None), (10, "a", 0, None, 0), (20, "a", None, None, None), (30, "a", None, None, None), (55, "a", None, None, None), (60, "b", 50, "a", 50), (65, "b", None, None, None), (200, "b", None, None, None)]


def test_quality_states(spark):
    o = monitors.Quality(first=50, period=10, factor=5, consecutive=2, transition=30, quantile=0.5)
    scores = [(t, 10.0) for t in range(0, 50, 10)] + [(50, 20.0), (60, 5.0), (62, 5.0), (64, 5.0), (66, 5.0), (70, 5.0), (72, 5.0), (80, 20.0), (82, 5.0), (84, 5.0), (90, 5.0), (100, 5.0), (110, 5.0), (120, 20.0), (130, 20.0), (140, 20.0)]
    df = spark.createDataFrame([(1, t, t, s) for t, s in scores] + [(2, 5, 5, None), (None, 1, 1, 1.0)], "k int, ms long, event long, score double")
    got = [(r.ms, r.degraded, r.debounced, r.state, r.flag) for r in monitors.quality(df, "k", "event", o).orderBy("ms").collect()]
    assert got == [
        (50, False, False, "regular", 0), (60, True, False, "examined", 0), (62, True, False, "examined", 0), (64, True, True, "examined", 1), (66, True, True, "examined", 1), (70, True, True, "transition", 1),
        (80, False, True, "examined", 1), (82, True, True, "transition", 1), (100, True, True, "transition", 2), (110, True, True, "transition", 2), (120, False, True, "transition", 2), (130, False, False, "regular", 0), (140, False, False, "regular", 0),
    ]


def coded(counts):
    """Counts to text, as files have it."""
    out = ""
    for i, c in enumerate(counts):
        x, more = c - (counts[i - 2] if i > 2 else 0), True
        while more:
            low, x = x & 31, x >> 5
            more = x != -1 if low & 16 else x != 0
            out += chr((low | 32 if more else low) + 48)
    return out


def dense(runs, n):
    m = np.zeros(n, bool)
    for s, k in runs:
        m[s : s + k] = True
    return m


def runs_of(m):
    edge = np.flatnonzero(np.diff(np.concatenate([[0], m.astype(int), [0]])))
    return [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def test_mask_codec_and_sets_equal_dense_masks(spark):
    rng, h, w = np.random.default_rng(1), 9, 11
    some = [np.repeat(rng.random(25) < 0.5, 4)[: h * w - 3].tolist() + [bool(rng.random() < 0.5)] * 3 for _ in range(30)] + [[False] * (h * w), [True] * (h * w)]
    rows = [(k, runs_of(np.array(a)), runs_of(np.array(b))) for k, (a, b) in enumerate(zip(some, some[::-1], strict=True))]
    df = spark.createDataFrame(rows, "k int, a array<struct<start:bigint,length:bigint>>, b array<struct<start:bigint,length:bigint>>")
    counts = M.counts_of_runs(F.col("a"), F.lit(h * w))
    out = df.select("k", counts.alias("counts"), M.text_of_counts(counts).alias("text"), M.runs_of_counts(M.counts_of_text(M.text_of_counts(counts))).alias("back"), M.union(F.col("a"), F.col("b")).alias("u"), M.intersection(F.col("a"), F.col("b")).alias("i"), M.area(F.col("a")).alias("n"), M.bounds(F.col("a"), F.lit(h)).alias("box")).collect()
    plain = lambda runs: [tuple(r) for r in runs]
    for r in out:
        a, b = np.array(some[r.k]), np.array(some[::-1][r.k])
        assert r.text == coded(r.counts) and sum(r.counts) == h * w and plain(r.back) == runs_of(a)
        assert plain(r.u) == runs_of(a | b) and (dense(plain(r.i), h * w) == (a & b)).all() and r.n == a.sum()
        x, y = np.nonzero(a.reshape(w, h))
        assert (tuple(r.box) if r.box else None) == ((x.min(), y.min(), np.ptp(x) + 1, np.ptp(y) + 1) if len(x) else None)
    big = spark.createDataFrame([([5_000_000, 3, 9_000_000_000, 1, 2, 70_000],)], "c array<bigint>")
    r = big.select(M.text_of_counts(F.col("c")).alias("t"), "c").first()
    assert r.t == coded(r.c) and big.select(M.counts_of_text(M.text_of_counts(F.col("c"))).alias("c")).first().c == r.c


def test_mask_files(spark, tmp_path):
    from trackloom.sources import masks as S

    (tmp_path / "0002.txt").write_text(f"1 7 2 9 11 {coded([5, 4, 90])}\nshort 1\n3 8 1 9 11 {coded([0, 99])}\n\n")
    got = S.read_masks(spark, f"{tmp_path}/0002.txt").orderBy("frame").collect()
    assert [(r.seq, r.frame, r.id, r.cls, [tuple(x) for x in r.mask]) for r in got] == [("0002", 1, 7, 2, [(5, 4)]), ("0002", 3, 8, 1, [(0, 99)])]


def test_boundary_score_equals_all_distances(monkeypatch):
    monkeypatch.setattr(B, "NEAR", 0.1)
    rng, h, w = np.random.default_rng(6), 14, 19
    radius = math.ceil(0.1 * math.hypot(h, w))

    def outline(m):
        at = lambda x, y: m[x, y] if x < w and y < h else None
        return {(x, y) for x in range(w) for y in range(h) if any(v is not None and v != m[x, y] for v in ((at(x + 1, y), at(x, y + 1), at(x + 1, y + 1))))}

    for k in range(40):
        a, b = np.zeros((w, h), bool), np.zeros((w, h), bool)
        for m in (a, b) if k else (a,):
            x, y = rng.integers(0, w - 2), rng.integers(0, h - 2)
            m[x : x + rng.integers(1, w), y : y + rng.integers(1, h)] = True
        p, q = outline(a), outline(b)
        near = lambda s, t: sum(any((x - u) ** 2 + (y - v) ** 2 <= radius**2 for u, v in t) for x, y in s) / len(s)
        want = float(len(p) == len(q)) if not p or not q else (2 * (n := near(p, q)) * (m := near(q, p)) / (n + m) if near(p, q) + near(q, p) else 0.0)
        assert abs(B.agreement(runs_of(a.ravel()), runs_of(b.ravel()), h, w) - want) < 1e-12


def test_last_frame_comes_from_the_table(spark, tmp_path):
    rows = [(1, 5), (1, 900), (2, 3)]
    got = V.every_frame(spark.createDataFrame(rows, "seq long, frame long")).groupBy("seq").agg(F.count("*").alias("n"), F.max("frame").alias("m")).collect()
    assert {(r.seq, r.n, r.m) for r in got} == {(1, 900, 900), (2, 900, 900)}
