"""Trackers that know what boxes look like."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom import registry
from trackloom.trackers import looks
from trackloom.trackers.frames import track
from trackloom.trackers.kernels import TRACKERS, Tracks, run

registry.load()
RED, BLUE = np.array([1.0, 0.1, 0.0, 0.2]), np.array([0.0, 0.2, 1.0, 0.1])


def bounce(n=40, gap=()):
    """Two boxes that run at each other, touch in the middle and turn round; ``gap``: frames in which they aren't detected."""
    frames = {}
    for f in range(1, n + 1):
        off = abs(f - n / 2) * 3 + 4
        if f not in gap:
            frames[f] = np.array([[500 - off, 100, 40, 40, 0.9, 0, *(RED + 0.01 * (f % 3))], [500 + off, 100, 40, 40, 0.9, 0, *(BLUE + 0.01 * (f % 4))]])
    return frames


def who(frames, out):
    """Of each id the looks (0 red, 1 blue) of the boxes nearest to it."""
    got = {}
    for f, i, x, *_ in out:
        if f in frames:
            got.setdefault(i, []).append(int(np.abs(frames[f][:, 0] - x).argmin()))
    return got


@pytest.mark.parametrize("plain, knowing", [("deepsort_motion", "deepsort"), ("hybridsort", "hybridsort_reid"), ("bytetrack", "bytetrack_reid")])
def test_looks_keep_ids_that_motion_swaps(plain, knowing):
    frames = bounce(gap=range(19, 23))
    swapped = who(frames, run({f: r[:, :6] for f, r in frames.items()}, TRACKERS[plain]))
    kept = who(frames, run(frames, TRACKERS[knowing]))
    assert any(len(set(v)) == 2 for v in swapped.values())
    late = lambda v: v[len(v) * 3 // 4 :]
    assert len(kept) == 2 and all(set(late(v)) == {v[0]} for v in kept.values())


def test_crossings_settle_as_the_best_permutation():
    rng = np.random.default_rng(1)
    for n in (2, 3, 4, 5):
        cost = rng.random((n, n))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert abs(cost[np.arange(n), looks.best_order(cost)].sum() - best) < 1e-12
    assert looks.best_order(np.zeros((3, 3))).tolist() == [0, 1, 2]
    big = rng.random((9, 9))
    assert sorted(looks.best_order(big).tolist()) == list(range(9)) and big[np.arange(9), looks.best_order(big)].sum() <= np.trace(big)


def test_a_swap_needs_a_gain():
    same = {f: np.column_stack([r[:, :6], np.tile(RED, (2, 1))]) for f, r in bounce(gap=range(19, 23)).items()}
    ids = lambda o: [r[:3] for r in run(same, o)]
    assert ids(TRACKERS["bytetrack_reid"]) == [r[:3] for r in run({f: r[:, :6] for f, r in same.items()}, TRACKERS["bytetrack"])]


def test_gallery_is_bounded_and_nearest_counts():
    g = looks.Gallery(3, RED)
    for k in range(5):
        g.add(RED * (k + 1))
    g.add(BLUE)
    assert len(g.kept) == 3
    d = looks.nearest([g], np.stack([BLUE * 7, RED, -RED]))
    assert np.allclose(d[0], [0, 0, 1 - max(float(-looks.unit(RED) @ looks.unit(v)) for v in (RED, BLUE))])
    assert looks.smoothed([g], np.stack([RED]))[0, 0] < 0.05


def test_proposals_bridge_missed_detections():
    frames = {f: np.array([[10.0 + 5 * f, 50, 40, 80, 0.9, 0, *RED]]) for f in range(1, 31) if f not in (12, 13, 14)}
    frames |= {f: np.zeros((0, 10)) for f in (12, 13, 14)}
    got = {f: (i, x) for f, i, x, *_ in run(frames, TRACKERS["motdt"])}
    assert {12, 13, 14} <= set(got) and len({i for i, _ in got.values()}) == 1
    assert all(abs(got[f][1] - (10 + 5 * f)) < 6 for f in (12, 13, 14))
    plain = {f for f, *_ in run({f: r[:, :6] for f, r in frames.items()}, TRACKERS["bytetrack"])}
    assert not plain & {12, 13, 14}
    gone = {f: r for f, r in frames.items() if f <= 11} | {f: np.zeros((0, 10)) for f in range(12, 60)}
    shown = [f for f, *_ in run(gone, TRACKERS["motdt"])]
    assert 12 < max(shown) < 30  # the score of a track alone fades
    assert looks.reliability(2, 0) == 0 and looks.reliability(20, 3) < looks.reliability(20, 1) < 1


def test_better_scored_detections_suppress_proposals():
    t = Tracks(TRACKERS["motdt"])
    t.start(1, np.array([[0.0, 0, 10, 10, 0.9, 0, *RED]]))
    t.hits[:] = 9
    row = np.array([[0.5, 0, 10, 10, 0.95, 0, *RED]])
    kept, proposed = looks.proposals(t, row, 2, 0.4)
    assert len(kept) == 1 and not len(proposed)
    kept, proposed = looks.proposals(t, row[:0], 2, 0.4)
    assert not len(kept) and len(proposed) == 1 and np.isnan(proposed[0, 6:]).all()


def test_trackers_take_looks_from_a_column(spark):
    frames = bounce(gap=range(19, 23))
    rows = [(k, f, *map(float, r[:5]), int(r[5]), [float(x) for x in r[6:]]) for k in (1, 2) for f, rs in frames.items() for r in rs]
    df = spark.createDataFrame(rows, "seq long, frame long, x double, y double, w double, h double, score double, cls long, looks array<double>")
    want = sorted((k, f, i) for k in (1, 2) for f, i, *_ in run(frames, TRACKERS["deepsort"]))
    got = track(df.orderBy(F.rand(3)), "deepsort").select("seq", "frame", "id").collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("name", ["track_deepsort", "track_hybridsort_reid", "track_botsort_reid", "track_motdt", "track_bytetrack_reid"])
def test_an_id_is_in_a_frame_once(spark, name):
    got = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert got.count() > 100 and got.groupBy("seq", "frame", "id").count().filter("count > 1").isEmpty()
