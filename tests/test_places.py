"""Trackers that look at places, and the precision of whole tracks, by hand and by brute force."""

from collections import defaultdict, deque
from dataclasses import replace

import numpy as np

from trackloom import registry
from trackloom import views as V
from trackloom.metrics.trackap import RANGES, THRESHOLDS
from trackloom.trackers import places as P
from trackloom.trackers.kernels import PUBLIC, TRACKERS, run

SF = "/root/testdata/sf0.001"
registry.load()
SQUARE = np.array([[0.0, 0], [50, 0], [100, 0], [100, 100], [0, 100]])
RIGHT = np.array([[0.0, 0], [0, 100], [100, 100], [100, 0]])  # entry on the left, exit on the right


def box(x, y=100.0, score=0.9, cls=0.0):
    return (x, y, 40.0, 30.0, score, cls)


def frames(*rows):
    return {f: np.array(r, float).reshape(-1, 6) for f, r in enumerate(rows, 1) if len(r)}


def ids(out, frame):
    return {round(r[2]): r[1] for r in out if r[0] == frame}


def test_short_excursions_move_onto_the_border():
    way = deque(map(np.array, [(50.0, 50.0), (105.0, 50.0), (110.0, 40.0), (60.0, 50.0)]))
    assert P.settle(way, [SQUARE]).tolist() == [60, 50]
    assert [p.tolist() for p in way] == [[50, 50], [100, 50], [100, 40], [60, 50]]
    long = deque([np.array([50.0, 50.0]), *[np.array([105.0, 50.0])] * (P.EXCURSION + 1), np.array([60.0, 50.0])])
    P.settle(long, [SQUARE])
    assert long[1].tolist() == [105, 50]
    outside = deque([np.array([50.0, 50.0]), np.array([150.0, 50.0])])
    assert P.settle(outside, [SQUARE]).tolist() == [150, 50]


def test_ways_turn_into_the_cone():
    begin, half = np.array([50.0, 50.0]), np.pi / 4  # the ways cross at a right angle
    for angle in np.linspace(-np.pi, np.pi, 41)[1:-1]:
        end = begin + 10 * np.array([np.cos(angle), np.sin(angle)])
        got = P.within_cone(begin, end, RIGHT) - begin
        want = np.clip(angle, -half, half)
        assert np.allclose(got, 10 * np.array([np.cos(want), np.sin(want)]), atol=1e-6)
    assert P.within_cone(begin, begin - 2.9, RIGHT).tolist() == [47.1, 47.1] or np.hypot(2.9, 2.9) > P.SHORTEST
    assert P.within_cone(begin, begin - [2.9, 0], RIGHT).tolist() == [47.1, 50]


def test_tracks_against_the_direction_are_turned():
    drift = frames(*[[box(300 - 4 * f)] for f in range(30)])
    region = ((-500.0, -500.0), (-500.0, 700.0), (700.0, 700.0), (700.0, -500.0))
    free, held = run(drift, TRACKERS["fasttracker"]), run(drift, replace(TRACKERS["fasttracker"], regions=(region,)))
    assert len(free) == 30 and free[-1][2] < 200 and [r[:2] for r in held[:11]] == [r[:2] for r in free[:11]]
    assert max(r[2] for r in held) > 300


def test_public_detections_gate_starts():
    rows = frames(*[[box(0), box(200)]] * 4)
    gate = {f: np.array([[201.0, 100, 40, 30]]) for f in (2, 3)}
    assert run(rows, PUBLIC) == []
    assert {(r[0], r[1], round(r[2])) for r in run(rows, PUBLIC, gate)} == {(f, 1, 200) for f in (2, 3, 4)}
    assert P.announced(rows[1], np.zeros((0, 4)), 0.5).shape == (0, 6) and P.announced(np.zeros((0, 6)), gate[2], 0.5).shape == (0, 6)
    twice = P.announced(rows[1][:1], np.array([[0.0, 100, 40, 30]] * 2), 0.5)
    assert len(twice) == 1


def test_classes_keep_apart_after_a_gap():
    rows = frames([box(0)], [box(0)], [], [], [box(2, cls=1.0)], [box(2, cls=1.0)])
    assert {r[1] for r in run(rows, TRACKERS["ocsort"])} == {1}
    assert [r[1] for r in run(rows, TRACKERS["ocsort_by_class"])][:2] == [1, 1] and 1 not in {r[1] for r in run(rows, TRACKERS["ocsort_by_class"]) if r[0] > 2}


def test_standing_tracks_are_not_taken_along():
    stands, passing = [[box(100)]] * 20, [[box(108 + 6 * f)] for f in range(12)]
    rows = frames(*stands, *passing, *[[box(100), box(180 + 6 * f)] for f in range(3)])
    plain = run(rows, replace(TRACKERS["bytetrack_guarded"], parked=()))
    assert set(ids(plain, 32).values()) == {1}
    guarded = run(rows, TRACKERS["bytetrack_guarded"])
    after = ids(guarded, 35)
    assert after[100] == 1 and all(i != 1 for x, i in after.items() if x != 100)


def test_standing_tracks_are_held_and_guarded():
    o = TRACKERS["bytetrack_guarded"]
    rows = {**frames(*[[box(100)]] * 20), 100: np.array([box(100)])}
    assert ids(run(rows, o), 100) == {100: 1} and 1 not in ids(run(rows, replace(o, parked=())), 100).values()
    assert ids(run({**frames(*[[box(100)]] * 20), 400: np.array([box(100)])}, o), 400).get(100) != 1  # not for ever
    beside = {**frames(*[[box(100)]] * 20), 30: np.array([box(120, 112)]), 31: np.array([box(120, 112)])}
    assert not ids(run(beside, replace(o, first=0.1)), 31)  # too far to match, too near to start


def test_lost_tracks_that_left_the_picture_match_no_more():
    moving = [[box(20 + 10 * f)] for f in range(15)]  # the last one ends at the border of 200
    rows = frames(*moving, [], [], [box(185)], [box(185)])
    o = replace(TRACKERS["bytetrack_plus"], freeze=False)
    assert set(r[1] for r in run(rows, o)) == {1}
    assert 1 not in {r[1] for r in run(rows, replace(o, picture=(200.0, 1000.0))) if r[0] > 15}


def test_track_precision_against_dense_matching(spark):
    def tracks(df, scored):
        out = defaultdict(dict)
        for r in df.collect():
            cut = 1000 * (r.frame // 240) if not scored else 0
            out[(r.seq, (r.id + cut) % 2, r.id + cut)][r.frame] = (r.x, r.y, r.w, r.h, (r.id * 3 + r.frame) % 7 / 10 + 0.3)
        return out

    def iou(a, b):
        inter = 0.0
        for f in a.keys() & b.keys():
            (ax, ay, aw, ah, _), (bx, by, bw, bh, _) = a[f], b[f]
            inter += max(0, min(ax + aw, bx + bw) - max(ax, bx)) * max(0, min(ay + ah, by + bh) - max(ay, by))
        size = lambda t: sum(w * h for _, _, w, h, _ in t.values())
        return inter / (size(a) + size(b) - inter)

    gt, dt = tracks(V.ground_truth(spark, SF), False), tracks(V.tracks(spark, SF), True)
    got = {(r.cls, r.span, r.threshold): (r.ap, r.recall) for r in registry.QUERIES["track_average_precision"](spark, SF).collect()}
    want = {}
    for cls in {k[1] for k in gt}:
        g, d = sorted(k for k in gt if k[1] == cls), sorted((k for k in dt if k[1] == cls), key=lambda k: (-round(np.mean([b[4] for b in dt[k].values()]), 12), k))
        sims = {(a, b): iou(dt[a], gt[b]) for a in d for b in g if a[0] == b[0]}
        for span, (field, low, high) in RANGES.items():
            value = lambda t: len(t) if field == "n" else np.mean([b[2] * b[3] for b in t.values()])  # noqa: E731, B023
            ok = lambda t: low <= value(t) <= high  # noqa: E731, B023
            n = sum(ok(gt[b]) for b in g)
            for limit in THRESHOLDS if n else []:
                used, tp, all_ = set(), [], []
                for a in d:
                    free = [(sims[a, b], b) for b in g if b not in used and sims.get((a, b), 0) >= limit / 100 - 1e-12]
                    counted = [x for x in free if ok(gt[x[1]])]
                    if free:
                        used.add(max(counted or free)[1])
                    if counted or (not free and ok(dt[a])):
                        tp.append((tp[-1] if tp else 0) + bool(counted))
                        all_.append(len(tp))
                rc, pr = np.array(tp) / n, np.array(tp) / np.array(all_) if tp else np.zeros(0)
                pr = np.maximum.accumulate(pr[::-1])[::-1]
                at = [np.searchsorted(rc + 1e-12, j / 100) for j in range(101)]
                want[cls, span, limit] = (sum(pr[i] if i < len(pr) else 0.0 for i in at) / 101, rc[-1] if len(rc) else 0.0)
    assert got.keys() == want.keys() and max(v[0] for v in want.values()) > 0.5
    assert all(np.allclose(got[k], want[k], atol=2e-6) for k in want), [(k, got[k], want[k]) for k in want if not np.allclose(got[k], want[k], atol=2e-6)][:5]
