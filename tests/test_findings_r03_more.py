"""More cases of the third round of findings: what is compared with what, at sizes at which all pairs would not do."""

import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from trackloom import registry
from trackloom.operators import cases as C
from trackloom.operators import joins as J
from trackloom.operators.near import Near
from trackloom.streaming import entities as E

registry.load()


def overlapping(a, b):
    return min(a[0] + a[2], b[0] + b[2]) > max(a[0], b[0]) and min(a[1] + a[3], b[1] + b[3]) > max(a[1], b[1])


def test_boxes_near_are_all_that_overlap():
    """Random boxes, some far larger than a cell, some moved, some dropped, one without an end."""
    r = np.random.default_rng(1)
    near, kept = Near(), {}
    for i in range(600):
        k = int(r.integers(0, 300))
        kept[k] = (*(r.random(2) * 3000 - 1000), *(r.random(2) * (3000 if i % 20 == 0 else 90)))
        near.put(k, kept[k])
        if i % 3 == 0:
            gone = int(r.integers(0, 300))
            kept.pop(gone, None)
            near.drop(gone)
    near.put(-1, (0.0, 0.0, float("inf"), 10.0))
    assert set(near.boxes) == {*kept, -1}
    for box in [*kept.values(), (-5000.0, -5000.0, 9000.0, 9000.0)]:
        assert {k for k, b in kept.items() if overlapping(b, box)} | {-1} <= near.around(box)


def test_plates_of_a_full_place_take_seconds():
    """12,000 plates that stay apart: each against all is minutes."""
    rule, began = C._Plates(0.7, 100), time.perf_counter()
    told = [r for ms in (1, 2) for i in range(12_000) for r in rule.step(ms, i + 100_000 * ms, "P", i % 100 * 50.0, i // 100 * 50.0, 16.0, 6.0)]
    assert len(told) == 12_000 and {r[0] for r in told} == {1} and time.perf_counter() - began < 10
    assert rule.step(103, 1, "P", 0.0, 0.0, 16.0, 6.0) == [(103, 1, "P")] and len(rule.still) == 1  # the others are forgotten


def test_listed_places_of_a_camera_take_seconds():
    """12,000 entities of low confidence leave their places; those who come after are listed there, others not."""
    fold, began = E.Registry(E.Options(gap=5, keep=1000, listed_for=10_000)), time.perf_counter()
    at = lambda i: (i % 100 * 50.0, i // 100 * 50.0, 40.0, 30.0)
    out = [r for i in range(12_000) for r in fold.step(1, i, 0, 0.1, *at(i))] + fold.expire(7)
    assert sum(r[2] == "removed" for r in out) == 12_000 == len(fold.places)
    late = [fold.step(8, 100_000 + i, i % 2, 0.9, *at(i))[0] for i in range(12_000)]
    assert [r[4] for r in late] == [i % 2 == 0 for i in range(12_000)] and time.perf_counter() - began < 10
    assert fold.step(10_002, 7, 1, 0.9, *at(7)) and not fold.places


def pairs_planned(df):
    """Joins of a plan, with their conditions."""
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_parts_meet_wholes_in_cells(spark):
    boxes = spark.createDataFrame([(0, 1, i, 50.0 * i, 0.0, 40.0, 30.0) for i in range(-3, 300)], "seq long, frame long, id long, x double, y double, w double, h double")
    parts = boxes.withColumns({"x": F.col("x") + 4, "w": F.lit(6.0), "h": F.when(F.col("id") == 5, 0.0).otherwise(6.0)})
    found = J.best_overlap(parts, boxes, ["seq", "frame"], 0.9)
    assert sorted((r.part, r.whole, r.share) for r in found.collect()) == [(i, i, 1.0) for i in range(-3, 300) if i != 5] and "__cx" in pairs_planned(found)


def test_whole_tracks_meet_in_cells(spark):
    df = registry.QUERIES["track_average_precision"](spark, "/root/testdata/sf0.001")
    assert "__cx" in pairs_planned(df)


def test_equal_masks_of_a_frame_are_compared_once(spark):
    """Ids of one mask pair up among themselves, those of two masks with each other, and never across frames."""
    one, two = [(0, 10), (50, 10)], [(5, 10), (50, 10)]
    rows = [(f, i, m) for f in (1, 2) for i, m in ((4, one), (1, two), (3, one), (2, two), (9, [(500, 1)]))] + [(1, 5, None), (1, None, one), (3, 1, one)]
    df = spark.createDataFrame(rows, "frame long, id long, mask array<struct<start:bigint,length:bigint>>")
    got = sorted(map(tuple, J.mask_pairs(df, ["frame"], "id", "mask").collect()))
    want = {(1, 2): 1.0, (3, 4): 1.0, **{(a, b): 0.6 for a in (1, 2) for b in (3, 4)}, **{(a, 9): 0.0 for a in (1, 2, 3, 4)}}
    assert got == sorted((f, *p, v) for f in (1, 2) for p, v in want.items())
    assert "collect_list" in pairs_planned(registry.QUERIES["mask_pairs"](spark, "/root/testdata/sf0.001"))


def test_routes_of_one_sequence_are_dealt_to_tasks(spark):
    plan = pairs_planned(registry.QUERIES["route_similarity"](spark, "/root/testdata/sf0.001"))
    assert "part" in plan and "array_intersect" not in plan


def test_pairs_over_frames_are_those_of_all_meetings(spark):
    """Blocks of a few ids and batches of a few rows, cut within frames; an id of null and one that never meets."""
    from trackloom.operators.together import together

    r = np.random.default_rng(4)
    rows = [(s, f, i, float(r.integers(0, 60)), 0.0, 10.0, 10.0) for s in (0, 1) for f in range(1, 30) for i in range(20) if r.random() < 0.5]
    schema = "seq long, frame long, id long, x double, y double, w double, h double"
    df = spark.createDataFrame([*rows, (0, 3, None, 1.0, 0.0, 10.0, 10.0), (0, 99, 77, 1.0, 0.0, 10.0, 10.0)], schema)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for ordered in (True, False):
            got = {tuple(x) for x in together(df, df, lambda a, b: np.where(np.abs(a[0] - b[0]) < 20, np.abs(a[0] - b[0]), np.nan), ordered, block=6).collect()}
            met = {}
            for s, f, i, x, *_ in rows:
                for t, g, j, y, *_ in rows:
                    if s == t and f == g and abs(x - y) < 20 and (i < j or not ordered):
                        met.setdefault((s, i, j), []).append((f, abs(x - y)))
            one = {(0, 77, 77, 0.0, 99, 99, 1)} if not ordered else set()
            assert got == {(*k, min(d for _, d in v), min(f for f, _ in v), max(f for f, _ in v), len(v)) for k, v in met.items()} | one
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_gallery_lists_leave_out_and_order_as_all_pairs_do(spark):
    """Blocks of seven rows, equal vectors, unknown labels, a null vector and one that is too short."""
    from trackloom.operators.reciprocal import gallery_lists

    r = np.random.default_rng(6)
    some = r.integers(-2, 3, (6, 4)) / 4
    rows = [(i, some[r.integers(0, 6)].tolist(), None if i % 9 == 0 else int(i % 3), i % 2) for i in range(60)]
    rows[7], rows[8] = (7, None, 1, 1), (8, [0.5], 2, 0)
    got = {}
    for q, v, n in map(tuple, gallery_lists(spark.createDataFrame(rows, "i long, v array<double>, label int, cam int"), 5, F.col("i") % 5 < 2, block=7).collect()):
        got.setdefault(q, {})[n] = v
    far = lambda x, y: round(1 - float(np.dot(x, y)), 9) if x and y and len(x) == len(y) == 4 else float("inf")
    for i, v, label, cam in rows:
        if i % 5 < 2:
            others = sorted((far(v, w), j) for j, w, m, c in rows if i != j and (c != cam or (m is not None and label is not None and m != label)))
            assert got.pop(i) == {n: j for n, (_, j) in enumerate(others[:5], 1)}
    assert not got


def test_polygons_do_not_pass_through_the_driver(spark):
    plan = registry.QUERIES["polygons_on_boxes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_triples_are_those_of_all_meetings(spark):
    """Blocks of a few ids and batches of a few rows; rows that come twice, an id of null and one that is alone. No triple is shuffled."""
    from trackloom.operators.together import triples

    r = np.random.default_rng(9)
    rows = [(s, f, i) for s in (0, 1) for f in range(1, 20) for i in range(18) if r.random() < 0.4]
    rows += [*rows[:30], (0, 3, None), (None, 3, 1), (0, 99, 3)]
    df = spark.createDataFrame(rows, "seq long, frame long, id long")
    met = Counter()
    for s, f, a in rows:
        for t, g, b in rows:
            if s is not None and s == t and f == g and a is not None and b is not None and a % 3 == 0 and b % 3 == 1:
                met.update((s, a, b, c) for u, h, c in rows if u == s and h == f and c is not None and c % 3 == 2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = triples(tuple(df.filter(F.col("id") % 3 == k) for k in range(3)), blocks=(2, 3, 4))
        got = [tuple(x) for x in found.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(got) == sorted((*k, n) for k, n in met.items())
    assert "Join" not in pairs_planned(registry.QUERIES["co_occurrence"](spark, "/root/testdata/sf0.001"))


def test_costs_are_worked_out_once_for_equal_boxes(spark):
    plan = pairs_planned(registry.QUERIES["association_costs"](spark, "/root/testdata/sf0.001"))
    assert "collect_list" in plan and plan.index("explode") < plan.index("Join")


def test_ranks_of_good_rows_are_those_of_sorted_galleries(spark):
    """Batches of seven rows, classes of labels and parts of queries; equal vectors, unknown labels, a null vector and one that is too short. No gallery is sorted."""
    from trackloom.operators.reciprocal import good_ranks

    r = np.random.default_rng(7)
    some = r.integers(-2, 3, (6, 4)) / 4
    rows = [(i, some[r.integers(0, 6)].tolist(), None if i % 9 == 0 else int(i % 5), i % 4) for i in range(80)]
    rows[7], rows[8] = (7, None, 2, 3), (8, [0.5], 3, 0)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {x.query_id: x for x in good_ranks(spark.createDataFrame(rows, "i long, v array<double>, label int, cam int"), F.col("i") % 3 == 0, labels=2, pairs=50).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    far = lambda x, y: round(1 - float(np.dot(x, y)), 9) if x and y and len(x) == len(y) == 4 else float("inf")
    for i, v, label, cam in rows:
        if i % 3 == 0:
            others = sorted((far(v, w), j, m) for j, w, m, c in rows if i != j and (c != cam or (m is not None and label is not None and m != label)))
            at = lambda m: [n for n, x in enumerate(others, 1) if x[2] == m]  # noqa: B023, E731
            x = got.pop(i)
            assert x.size == len(others) and x.known == (label is not None)
            assert label is None or (x.good, x.unknown) == (at(label), at(None))
    assert not got and "Window" not in pairs_planned(registry.QUERIES["reid_ranking"](spark, "/root/testdata/sf0.001"))
