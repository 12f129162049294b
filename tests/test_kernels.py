"""Hand-computed accuracy cases, brute-force assignment, tracker invariants, streaming equivalence."""

import itertools

import numpy as np
import pandas as pd
import pytest

from trackloom.metrics import kernels as K
from trackloom.metrics.assignment import assign, assign_within
from trackloom.trackers.kernels import TRACKERS, overlap, run


def rows(*frames):
    """frames: lists of (gid, tid, sim); either id may be None."""
    return K.Sequence(pd.DataFrame([(f, g, t, s) for f, items in enumerate(frames, 1) for g, t, s in items], columns=["frame", "gid", "tid", "sim"]))


@pytest.mark.parametrize("seed", range(30))
def test_assignment_against_permutations(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 6, 2)
    cost = np.round(rng.random((n, m)), 2)
    r, c = assign(cost)
    assert len(r) == min(n, m) and len(set(c)) == len(c)
    a = cost if n <= m else cost.T
    best = min(sum(a[i, p[i]] for i in range(len(a))) for p in itertools.permutations(range(a.shape[1]), len(a)))
    assert abs(cost[r, c].sum() - best) < 1e-9


def test_assignment_limit_and_empty_sides():
    found, left, right = assign_within(np.array([[0.1, 0.9], [0.8, 0.95]]), 0.5)
    assert found == [(0, 0)] and left == [1] and right == [1]
    assert assign_within(np.zeros((0, 2)), 0.5) == ([], [], [0, 1])


def test_clear_without_switches():
    seq = rows([(1, 10, 1.0), (2, None, None)], [(1, 10, 1.0), (2, 20, 0.4)], [(1, None, None)], [(None, 10, None)])
    got = K.clear(seq)
    assert (got["tp"], got["fn"], got["fp"], got["idsw"]) == (2, 3, 2, 0)


def test_clear_counts_a_switch_and_keeps_the_earlier_partner():
    seq = rows([(1, 10, 0.9)], [(1, 10, 0.6), (1, 20, 0.9)], [(1, 20, 0.9)])
    got = K.clear(seq)
    assert got["tp"] == 3 and got["idsw"] == 1 and got["fp"] == 1  # frame 2 stays with 10


def test_threshold_is_inclusive_and_zero_overlap_is_no_match():
    assert K.clear(rows([(1, 10, 0.5)]))["tp"] == 1
    assert K.identity(rows([(1, 10, 0.5)]))["idtp"] == 1
    assert K.clear(rows([(1, 10, 0.0)]))["tp"] == 0


def test_identity_split_track():
    # one ground truth of five frames, followed by two tracks of two and three frames
    seq = rows(*[[(1, 10, 1.0)]] * 2, *[[(1, 20, 1.0)]] * 3)
    assert K.identity(seq) == {"idtp": 3, "idfn": 2, "idfp": 2}


def test_empty_sides():
    only_tracks = rows(*[[(None, t, None) for t in (1, 2, 3, 4)]] * 4)
    log = K.accumulate(only_tracks)
    assert len(log) == 16 and {e["type"] for e in log} == {"FP"}
    assert K.clear(only_tracks)["fp"] == 16 and K.identity(only_tracks)["idfp"] == 16
    assert K.clear(rows(*[[(1, None, None)]] * 3))["fn"] == 3


def test_hota_of_a_perfect_tracker_is_one():
    seq = rows(*[[(1, 10, 1.0), (2, 20, 1.0)]] * 4)
    for a in K.hota(seq):
        assert a["tp"] == 8 and a["fn"] == a["fp"] == 0 and abs(a["ass_sum"] / a["tp"] - 1) < 1e-12


def scene(n=4, frames=40, seed=0):
    """Objects that move apart on straight lines."""
    rng = np.random.default_rng(seed)
    v = rng.uniform(-1, 1, (n, 2))
    return {f: np.array([[100 * i + v[i, 0] * f, 50 * i + v[i, 1] * f, 40, 60, 0.9, 0] for i in range(n)]) for f in range(1, frames + 1)}


@pytest.mark.parametrize("name", sorted(TRACKERS))
def test_tracker_invariants(name):
    out = run(scene(), TRACKERS[name])
    per_frame = pd.DataFrame(out).groupby(0)[1]
    assert (per_frame.nunique() == per_frame.size()).all()  # ids are unique in a frame
    assert pd.DataFrame(out)[1].nunique() == 4  # no switches on easy input
    shuffled = {f: r[np.random.default_rng(f).permutation(len(r))] for f, r in scene().items()}
    assert run(shuffled, TRACKERS[name]) == out  # order of rows doesn't matter
    assert run({}, TRACKERS[name]) == []


def test_tracker_survives_a_gap():
    frames = {f: r for f, r in scene(2).items() if not 15 <= f <= 19}
    out = pd.DataFrame(run(frames, TRACKERS["ocsort"]))
    assert out[1].nunique() == 2


def test_cascade_lets_recently_seen_tracks_choose_first():
    # Track 1 is unseen from frame 3 on; at frame 5 the one detection lies between it and track 2, nearer to track 1.
    box = lambda x: [x, 0, 40, 60, 0.9, 0]
    frames = {f: np.array([box(0), box(6)]) for f in (1, 2)} | {f: np.array([box(6)]) for f in (3, 4)} | {5: np.array([box(2.0)])}
    at = {r[1] for r in run(frames, TRACKERS["deepsort_motion"]) if r[0] == 5}
    assert at == {2}


def test_batched_filter_against_dense_matrices():
    from trackloom.trackers.kalman import BoxFilter

    rng, f = np.random.default_rng(2), BoxFilter("xywh")
    z = rng.uniform(20, 90, (3, 5, 4))
    mean, cov = f.initiate(z[0])
    dense = [np.block([[np.diag(c[0]), np.diag(c[1])], [np.diag(c[1]), np.diag(c[2])]]) for c in cov]
    means = [m.copy() for m in mean]
    step = np.eye(8) + np.diag([1.0] * 4, 4)
    for k in (1, 2):
        scale = [np.array([m[2], m[3], m[2], m[3]]) for m in means]
        noise = [np.diag(np.concatenate([s / 20, s / 160]) ** 2) for s in scale]
        means = [step @ m for m in means]
        dense = [step @ p @ step.T + q for p, q in zip(dense, noise, strict=True)]
        mean, cov = f.predict(mean, cov)
        far = f.gating(mean, cov, z[k])
        for i, (m, p) in enumerate(zip(means, dense, strict=True)):
            s = p[:4, :4] + np.diag((np.array([m[2], m[3], m[2], m[3]]) / 20) ** 2)
            assert np.allclose(far[i], [(d := x - m[:4]) @ np.linalg.solve(s, d) for x in z[k]])
            gain = p[:, :4] @ np.linalg.inv(s)
            means[i], dense[i] = m + gain @ (z[k][i] - m[:4]), p - gain @ s @ gain.T
        mean, cov = f.update(mean, cov, z[k])
        assert np.allclose(mean, means) and np.allclose(cov[:, 0], [np.diag(p)[:4] for p in dense]) and np.allclose(cov[:, 1], [np.diag(p[:4, 4:]) for p in dense])


def test_overlap_of_boxes_without_area():
    assert overlap(np.array([[0, 0, 0, 0]]), np.array([[0, 0, 0, 0]]))[0, 0] == 0


def test_unknown_tracker_fails_at_plan_time(spark):
    from trackloom.trackers.frames import track

    with pytest.raises(NotImplementedError):
        track(spark.createDataFrame([], "seq long, frame long, x double, y double, w double, h double, score double, cls long"), "none")
