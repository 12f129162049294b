"""Findings of the fourth round."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trackloom import registry

registry.load()
SF = "/root/testdata/sf0.001"


def copied(spark, folder, events, embeddings=None):
    """A folder of tables: events (ts as text) and embeddings."""
    spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{folder}/events.parquet")
    if embeddings is not None:
        spark.createDataFrame(embeddings, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_looks_are_the_whole_vectors_of_all_users(spark, tmp_path):
    from trackloom.plans.tracking import looking

    users = [3, 55, 1003, 2500]
    events = [(k, f"2024-01-01 0{h}:00:00", u, "view", 1.0, "{}") for k, (u, h) in enumerate((u, h) for u in users for h in range(1, 7))]
    folder = copied(spark, tmp_path, events, [(u, [float(u + i) for i in range(64)], 0) for u in users[:3]] + [(2600, [0.5] * 64, 0)])
    rows = looking(spark, folder).collect()
    assert {(r.seq, int(r.x) // 50) for r in rows} == {(u % 8, u // 8) for u in users}
    for r in rows:
        user = int(r.x) // 50 * 8 + r.seq
        own = [float(user + i) if user != 2500 else 0.0 for i in range(64)]
        assert r.looks == pytest.approx([v + 0.02 * ((r.frame + i) % 5) for i, v in enumerate(own)])


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_equal_boxes_of_a_frame_are_compared_by_their_first(spark):
    from trackloom.operators.joins import foremost

    rng = random.Random(4)
    rows = [(rng.randrange(2), rng.randrange(2), i, float(rng.choice([0, 1, 2, 30])), 0.0, float(rng.choice([20, 21, 0])), 10.0) for i in range(120)]
    got = foremost(spark.createDataFrame(rows, "seq long, frame long, id long, x double, y double, w double, h double"), (-(F.col("id") % 5)).alias("o"), 0.85)

    def iou(a, b):
        over = max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])) * 10
        return over / (a[5] * 10 + b[5] * 10 - over) if over else 0

    before = lambda a, b: (-(a[2] % 5), a[2]) < (-(b[2] % 5), b[2])
    want = sorted(b[:3] for b in rows if not any(a[:2] == b[:2] and before(a, b) and iou(a, b) > 0.85 for a in rows))
    assert sorted(map(tuple, got.collect())) == want
    assert 0 < len(want) < len(rows)
    # Of equal boxes one row meets those of others: without that, a frame's pairs grow with the square of its ids.
    plan = planned(registry.QUERIES["without_duplicate_tracks"](spark, SF))
    assert "min(struct" in plan or "min(CASE" in plan


def test_suppression_holds_a_frame_at_a_time(spark):
    from trackloom.trackers import frames

    assert frames._kept.__code__.co_varnames[:3] == ("boxes", "limit", "most")
    rng = random.Random(7)
    rows = [(0, f, i, float(rng.randrange(60)), 0.0, 20.0, 10.0, rng.randrange(5) / 10, rng.randrange(2)) for f in range(300) for i in range(12)]
    df = spark.createDataFrame(rows, "seq long, frame long, id long, x double, y double, w double, h double, score double, cls long")
    got = frames.nms(df, 0.3, agnostic=True, most=3)
    assert "FlatMapGroups" not in planned(got)  # many frames in one Python call took memory with the square of a frame's boxes
    want = []
    for f in range(300):
        kept = []
        for r in sorted((r for r in rows if r[1] == f), key=lambda r: (-r[7], r[3], r[4], r[8], r[2])):
            over = [max(0.0, 20 - abs(r[3] - k[3])) for k in kept]
            if len(kept) < 3 and not any(o / (40 - o) > 0.3 for o in over):
                kept.append(r)
        want += [(f, r[2], r[8]) for r in kept]
    assert sorted((r.frame, r.id, r.cls) for r in got.collect()) == sorted(want)


def test_painting_holds_a_frame_and_bounded_pixels(spark, monkeypatch):
    from trackloom.operators import painting as P

    rng = random.Random(5)
    masks = [[(s, rng.randrange(1, 9)) for s in range(rng.randrange(9), 80, 20)] for _ in range(40)]
    whole = P.painted(masks)
    monkeypatch.setattr(P, "PIXELS", 50)
    assert P.painted(masks) == whole
    done, seen = set(), []
    for m in masks:
        own = {p for s, n in m for p in range(s, s + n)} - done
        done |= own
        seen.append(own)
    assert [{p for s, n in m for p in range(s, s + n)} for m in whole] == seen
    rows = [(0, f, i, 0.5, [(i % 3 * 10, 8)]) for f in range(3) for i in range(30)]
    got = P.without_overlap(spark.createDataFrame(rows, "seq long, frame long, id long, score double, mask array<struct<start:bigint,length:bigint>>"))
    assert "FlatMapGroups" not in planned(got)
    assert sorted((r.frame, r.id) for r in got.collect()) == [(f, i) for f in range(3) for i in range(3)]


def test_a_gallery_is_drawn_from_shelves_of_ids(spark, monkeypatch):
    from trackloom.plans import formats

    plan = planned(registry.QUERIES["single_shot_match"](spark, SF))
    assert "collect_list" in plan  # before: a row for each query, seed and vector was sorted
    whole = sorted(map(tuple, registry.QUERIES["single_shot_match"](spark, SF).collect()))
    monkeypatch.setattr(formats, "DRAWN", 16)
    assert sorted(map(tuple, registry.QUERIES["single_shot_match"](spark, SF).collect())) == whole and whole


def test_equal_boxes_meet_once_in_euclidean_pairs(spark, tmp_path):
    users = [0, 8, 16, 168, 672, 1344]  # of one sequence; the last three are at one place with the first
    events = [(k, "2024-01-01 01:00:00", u, "view", 1.0, "{}") for k, u in enumerate(users)]
    got = registry.QUERIES["euclidean_pairs"](spark, copied(spark, tmp_path, events))
    assert "collect_list" in planned(got)  # before: each id met each other one of its frame
    place = lambda u: (u % 7 * 15 + (40 + u % 4) / 2, u % 3 * 10.0)
    want = [(a, b, round(1 - math.dist(place(a), place(b)) / 60, 6)) for a in users for b in users if a < b and math.dist(place(a), place(b)) < 60]
    assert sorted((r.gid, r.tid, r.sim) for r in got.collect()) == want and len(want) > 3
