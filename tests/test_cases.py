"""Alert rules with a memory, by hand; average precision of boxes against plain loops."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from trackloom.metrics import boxap
from trackloom.operators import cases as C
from trackloom.trackers.kernels import overlap


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def test_votes_and_cooldown(spark):
    rows = [("a", t, v) for t, v in ((0, 1), (10, 1), (20, 0), (30, 1), (40, 1), (50, 1), (60, 1), (140, 1), (150, 1), (160, 1), (400, 1), (410, 1), (420, 1), (430, 0))] + [(None, 5, 1)]
    got = C.votes_with_cooldown(table(spark, rows, "k string, ms long, vote int"), ["k"], 15, 100, 3, 0.66, 100).collect()
    # 20: two of three; quiet until 120, then three more; the gap before 400 starts the dwell anew.
    assert sorted(tuple(r) for r in got) == [("a", 20, 2), ("a", 160, 3), ("a", 420, 3)]
    assert C.votes_with_cooldown(table(spark, rows, "k string, ms long, vote int"), ["k"], 15, 100, 3, 0.66, 100).filter("k is null").count() == 0


def test_bursts(spark):
    rows = [(1, t) for t in (0, 3, 10, 20, 21, 30, 130, 140, 300, 310)]
    got = C.bursts(table(spark, rows, "k int, ms long"), ["k"], 25, 5, 3, 100).collect()
    assert sorted(tuple(r) for r in got) == [(1, 20, 0)]  # 3 and 21 are too near, 30 is in the silence


def test_history_uses_the_latest_places(spark):
    box = lambda x: (x, 0.0, 10.0, 10.0)
    rows = [(1, 1, 11, 0, *box(0.0), [1.0, 0.0]), (1, 2, 12, 0, *box(100.0), None), (1, 3, 13, 0, *box(1.0), None), (1, 4, 14, 0, *box(200.0), None), (1, 5, 15, 0, *box(100.0), None), (1, 6, 16, 1, *box(100.0), None), (1, 7, 17, 0, *box(0.0), None), (1, 8, 18, 1, *box(108.0), [1.0, 0.1]), (1, 9, 19, 1, *box(108.0), [1.0, 0.1])]
    got = C.seen_before(table(spark, rows, "seq int, ms long, id long, cls long, x double, y double, w double, h double, looks array<double>"), "seq", 2, 0.6, 0.9).orderBy("ms").collect()
    # 12 was used before 11's place was again, so it is the one that 14 drives out.
    assert [(r.id, r.seen, r["first"]) for r in got] == [(11, False, 11), (12, False, 12), (13, True, 11), (14, False, 14), (15, False, 15), (16, False, 16), (17, False, 17), (18, False, 18), (19, True, 18)]


def test_lines_in_order(spark):
    rows = [("a", t, x) for t, x in ((0, 0), (5, 1), (9, 2), (20, 0), (21, 2), (22, 1), (30, 0), (35, 1), (90, 2), (100, 0), (101, 1), (102, 2), (110, 1), (111, 0), (112, 0), (115, 1), (120, 2))]
    got = C.lines_in_order(table(spark, rows, "k string, ms long, line int"), ["k"], 3, 4, 50).collect()
    assert sorted((r["first"], r["last"]) for r in got) == [(0, 9), (112, 120)]


def test_matches_are_held_and_told_once(spark):
    rows = [(7, t, c, s) for t, c, s in ((0, 1, 0.5), (4, 2, 0.9), (20, 3, 0.4), (30, 3, 0.99), (200, 4, 0.6), (201, 5, 0.7), (202, 6, 0.5), (500, 1, 0.3))]
    got = C.held_matches(table(spark, rows, "who int, ms long, camera long, score double"), "who", 10, 3, 100).collect()
    assert sorted(tuple(r) for r in got) == [(7, 10, 4, 2, 0.9, 2), (7, 202, 201, 5, 0.7, 3), (7, 510, 500, 1, 0.3, 1)]


def test_parked_plates_are_told_once(spark):
    rows = [(1, 0, 10, "A", 0.0), (1, 5, 11, "A", 1.0), (1, 9, 12, "B", 300.0), (1, 14, 12, "B", 400.0), (1, 40, 13, "A", 2.0)]
    df = table(spark, rows, "seq int, ms long, vehicle long, plate string, x double").withColumns({"y": F.lit(0.0), "w": F.lit(20.0), "h": F.lit(10.0)})
    got = C.plates_once(df, "seq", 0.7, 20).collect()
    assert sorted((r.ms, r.vehicle) for r in got) == [(0, 10), (9, 12), (40, 13)]


def plain_precision(gt, det):
    """(class, area, threshold) to average precision and recall, detection by detection."""
    out = {}
    for cls in sorted({g[1] for g in gt}):
        for area, (low, high) in boxap.AREAS.items():
            fits = lambda b: low <= b[2] * b[3] < high  # noqa: B023, E731
            n = sum(g[1] == cls and fits(g[2]) for g in gt)
            if not n:
                continue
            for least in boxap.OVERLAPS:
                flags, frames = [], defaultdict(list)
                for f, c, b, s in det:
                    if c == cls:
                        frames[f].append((s, b))
                for f, rows in frames.items():
                    own, used = [g[2] for g in gt if g[:2] == (f, cls)], set()
                    for s, b in sorted(rows, key=lambda r: (-r[0], *r[1])):
                        sim = lambda k: round(float(overlap(np.array([b]), np.array([own[k]]))[0, 0]), 12)  # noqa: B023, E731
                        able = [k for k in range(len(own)) if k not in used and sim(k) >= least - 1e-10]
                        able = [k for k in able if fits(own[k])] or able
                        if able:
                            k = max(able, key=lambda k: (sim(k), -k))
                            used.add(k)
                            if fits(own[k]):
                                flags.append((s, True))
                        elif fits(b):
                            flags.append((s, False))
                points = []
                for s in sorted({s for s, _ in flags}, reverse=True):
                    tp = sum(ok for v, ok in flags if v >= s)
                    points.append((tp / n, tp / sum(v >= s for v, _ in flags)))
                at = [max((p for r, p in points if r >= k / 100 - 1e-11), default=0) for k in range(101)]
                out[cls, area, least] = (sum(at) / 101, max((r for r, _ in points), default=0))
    return out


def test_box_precision_equals_plain_loops(spark):
    rng = np.random.default_rng(3)
    box = lambda: [float(x) for x in (*rng.integers(0, 120, 2), *rng.choice([20, 30, 60, 110], 2))]
    gt = [(int(f), int(c), tuple(box())) for f in (1, 2, 300) for c in (0, 1) for _ in range(4)]
    det = [(f, c, tuple(float(v) for v in np.array(b) + rng.integers(-3, 4, 4)), float(rng.choice([0.3, 0.5, 0.6, 0.9]))) for f, c, b in gt for _ in range(2)] + [(5, 1, (0.0, 0.0, 40.0, 40.0), 0.8)]
    g = spark.createDataFrame([(1, f, c, *b) for f, c, b in gt], "seq int, frame int, cls int, x double, y double, w double, h double")
    d = spark.createDataFrame([(1, f, c, s, *b) for f, c, b, s in det], "seq int, frame int, cls int, score double, x double, y double, w double, h double")
    got = {(r.cls, r.area, r.threshold): (r.ap, r.recall) for r in boxap.box_precision(g, d).collect()}
    want = plain_precision(gt, det)
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_painted_masks_keep_the_first_pixels():
    from trackloom.operators.painting import overlap_of, painted

    rng = np.random.default_rng(2)
    for _ in range(40):
        masks = [sorted((10 * k + int(rng.integers(0, 5)), int(rng.integers(1, 6))) for k in rng.choice(8, int(rng.integers(0, 5)), replace=False).tolist()) for _ in range(4)]
        sets = [{p for s, n in m for p in range(s, s + n)} for m in masks]
        got = [{p for s, n in m for p in range(s, s + n)} for m in painted(masks)]
        assert got == [s - set().union(*sets[:k]) for k, s in enumerate(sets)]
        for a, b, x, y in ((masks[0], masks[1], sets[0], sets[1]), (masks[2], masks[3], sets[2], sets[3])):
            assert overlap_of(a, b) == (len(x & y) / len(x | y) if x | y else 0.0)
    assert painted([[], []]) == [[], []]


def test_masks_are_followed(spark):
    from trackloom.operators.painting import followed

    m = lambda s: [(s, 10)]
    rows = [(1, f, i, m(s)) for f, i, s in ((1, 1, 0), (1, 2, 100), (2, 7, 101), (2, 8, 1), (3, 1, 200), (4, 1, 2), (4, 2, 202), (9, 1, 2))]
    got = {(r.frame, r.id): r.track for r in followed(table(spark, rows, "seq int, frame int, id int, mask array<struct<start:bigint,length:bigint>>"), 0.5, 2).collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (2, 7): 2, (2, 8): 1, (3, 1): 3, (4, 1): 1, (4, 2): 3, (9, 1): 4}


def test_labels_are_suppressed_across_classes(spark):
    from trackloom.trackers.frames import labelled, nms

    rows = [(1, 1, 1, 0.0, [0.9, 0.8, 0.1]), (1, 1, 2, 1.0, [0.2, 0.95, 0.0]), (1, 1, 3, 50.0, [0.5, 0.5, 0.3]), (1, 1, 4, 90.0, [0.1, 0.2, 0.0]), (1, 2, 5, 0.0, [0.0, 0.0, 0.6])]
    d = table(spark, rows, "seq long, frame long, id long, x double, scores array<double>").withColumns({"y": F.lit(0.0), "w": F.lit(10.0), "h": F.lit(10.0)})
    pick = lambda df: sorted((r.frame, r.id, r.cls, r.score) for r in df.collect())
    every, best = labelled(d, "scores", 0.25, True), labelled(d, "scores", 0.25, False)
    assert pick(best) == [(1, 1, 0, 0.9), (1, 2, 1, 0.95), (1, 3, 0, 0.5), (2, 5, 2, 0.6)]
    assert pick(every) == [(1, 1, 0, 0.9), (1, 1, 1, 0.8), (1, 2, 1, 0.95), (1, 3, 0, 0.5), (1, 3, 1, 0.5), (1, 3, 2, 0.3), (2, 5, 2, 0.6)]
    assert pick(nms(every, 0.3)) == [(1, 1, 0, 0.9), (1, 2, 1, 0.95), (1, 3, 0, 0.5), (1, 3, 1, 0.5), (1, 3, 2, 0.3), (2, 5, 2, 0.6)]
    assert [(f, i) for f, i, *_ in pick(nms(every, 0.3, agnostic=True, most=2))] == [(1, 2), (1, 3), (2, 5)]
