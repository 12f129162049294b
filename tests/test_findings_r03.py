"""Cases of the third round of findings."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom import registry
from trackloom.functions import geometry as G
from trackloom.functions.rounding import rounded
from trackloom.metrics import kernels as K
from trackloom.metrics.frames import per_sequence
from trackloom.plans.accuracy import CLEAR, EVENT_LOG, HOTA
from trackloom.trackers.frames import track
from trackloom.trackers.kernels import TRACKERS, overlap, overlapping, run, stream

registry.load()


def test_rounding_of_ties_is_duckdb_s(spark):
    row = spark.range(1).select(rounded(F.lit(323 / 640), 6).alias("a"), rounded(F.lit(0.1671875), 6).alias("b"), rounded(F.lit(-2.5), 0).alias("c"), F.round(F.lit(323 / 640), 6).alias("old")).first()
    assert tuple(row) == (0.504687, 0.167188, -3.0, 0.504688)


def test_share_on_a_tie(spark):
    """200.625 of 1,200, whichever way the sum over edges errs."""
    rows = registry.QUERIES["polygons_on_boxes"](spark, "/root/testdata/sf0.01").filter("seq = 3 and frame = 39 and id = 11 and polygon = 3").collect()
    assert [(r.common, r.share) for r in rows] == [(200.625, 0.167188)]


def test_upright_axis_keeps_its_sign(spark):
    """Covariance zero but for rounding noise of either sign: 90 degrees, never -90."""
    rows = [(k, x + s * e, y * 1.0) for k, s in ((0, 1), (1, -1)) for e, (x, y) in zip((0.0, 1e-15, 0.0, 1e-15), ((0.1, 1), (0.2, 9), (0.2, 1), (0.1, 9)), strict=True)]
    df = spark.createDataFrame(rows, "k int, x double, y double")
    assert {round(r.a, 4) for r in df.groupBy("k").agg(G.principal_axis(F.col("x"), F.col("y"))[0].alias("a")).collect()} == {90.0}


def crowd(n, seed=3):
    """Boxes that mostly lie apart, a few of them on one another."""
    r = np.random.default_rng(seed)
    return np.column_stack([r.random((n, 2)) * 40 * n**0.5, r.random((n, 2)) * 40 + 5])


@pytest.mark.parametrize("kind", ["iou", "hmiou", "ciou", "giou"])
def test_boxes_that_meet_are_those_that_overlap(kind):
    a, b = crowd(60), crowd(50, 4)
    i, j, sim = overlapping(a, b, kind)
    dense = overlap(a, b, kind)
    assert [tuple(p) for p in np.argwhere(dense > 0).tolist()] == list(zip(i.tolist(), j.tolist(), strict=True)) and np.array_equal(dense[i, j], sim)


@pytest.mark.parametrize("name", ["bytetrack_plus", "ocsort", "hybridsort_reid", "deepsort", "bytetrack_guarded"])
def test_trackers_hold_no_matrix_of_a_frame(name):
    """4,000 boxes: a matrix of them has 128 MB."""
    boxes, looks = crowd(4000), np.random.default_rng(5).random((4000, 8))
    frame = np.column_stack([boxes, np.full(4000, 0.9), np.zeros(4000), looks])
    tracemalloc.start()
    shown = sum(len(s) for s in stream(((f, frame) for f in range(1, 4)), TRACKERS[name]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert shown > 4000 and peak < 100e6


def test_frames_of_a_sequence_may_be_cut_anywhere(spark):
    """More rows than an Arrow batch holds, dealt out: as when each sequence is given whole."""
    rows = [(s, f, *b, 0.9, 0) for s in (0, 1) for f in range(1, 9) for b in (crowd(900, s) + [f, 0, 0, 0]).tolist()]
    df = spark.createDataFrame(rows, "seq long, frame long, x double, y double, w double, h double, score double, cls long").repartition(5)
    got = sorted(map(tuple, track(df, "bytetrack").collect()))
    want = []
    for s in (0, 1):
        frames = {f: np.array([r[2:] for r in rows if r[:2] == (s, f)]) for f in range(1, 9)}
        want += [(s, *r) for r in run(frames, TRACKERS["bytetrack"])]
    assert len(rows) > 10_000 and got == sorted(want)


def test_a_crowded_sequence_is_scored_without_matrices():
    """A frame of 5,000 pairs: a matrix of it has 200 MB."""
    n = 5000
    pdf = pd.DataFrame({"frame": np.repeat([1, 2], n), "gid": np.tile(np.arange(n), 2), "tid": np.concatenate([np.arange(n), np.arange(n)[::-1]]) + n, "sim": 0.9})
    tracemalloc.start()
    seq = K.Sequence(pdf)
    got, log = K.clear(seq), sum(1 for _ in K.events(seq))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got["tp"], got["idsw"], got["fn"], got["fp"]) == (2 * n, n, 0, 0) and log > 2 * n and peak < 60e6


@pytest.mark.parametrize(("kernel", "schema"), [(K.clear, CLEAR), (K.id_consistency, "share_sum double, ids long"), (K.events, EVENT_LOG), (K.hota, HOTA)])
def test_sequences_stream_through_their_kernels(spark, kernel, schema):
    """Frames cut anywhere by batches of seven rows, pairs that come twice, sides that are empty: as when a sequence is given whole."""
    r = np.random.default_rng(8)
    rows = [(s, f, g, t, None if g is None or t is None else round(float(r.random()), 2)) for s in (0, 1, None) for f in range(1, 30) for g in (None, *range(6)) for t in (None, *range(9, 14)) if r.random() < 0.4 and (g, t) != (None, None)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [tuple(x) for x in per_sequence(spark.createDataFrame(rows, "seq long, frame long, gid long, tid long, sim double").repartition(5), kernel, schema).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for s in (0, 1, None):
        found = kernel(K.Sequence(pd.DataFrame([x[1:] for x in rows if x[0] == s], columns=["frame", "gid", "tid", "sim"])))
        want += [(s, *(x.values() if isinstance(x, dict) else x)) for x in ([found] if isinstance(found, dict) else found)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_a_long_sequence_is_held_frame_by_frame():
    """A thousand frames of 500 pairs: as columns, a sequence has 28 MB and more."""
    own = np.arange(500)
    piece = lambda f: [(np.full(500, f), np.ones(500, bool), np.ones(500, bool), own, own + f % 2, np.full(500, 0.9))]
    for kernel in K.BY_FRAME:
        tracemalloc.start()
        found = kernel(K.Passing(piece(f) for f in range(1000)))
        n = len(found) if isinstance(found, dict) else sum(1 for _ in found)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n and peak < 5e6
