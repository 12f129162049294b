"""Cases of findings about sizes: what a row, a task or the driver holds, and that results stay as they are."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom import registry
from trackloom import views as V
from trackloom.operators import painting
from trackloom.plans import exchange, masks
from trackloom.sources import federated as S

registry.load()
SF = "/root/testdata/sf0.01"


def test_documents_do_not_grow_with_the_recording(spark):
    docs = exchange.annotated(spark, SF)
    sizes = [r.n for r in docs.select(F.length("value").alias("n")).collect()]
    assert len(sizes) > 100 and max(sizes) < sum(sizes) / 50


def test_annotations_do_not_carry_their_document(spark):
    """Ids hold within a document; an annotation without image, track or four numbers goes."""
    doc = '{"videos":[{"id":%d,"name":"v"}],"images":[{"id":1,"video_id":%d,"frame_index":7}],"tracks":[{"id":5,"category_id":%d,"video_id":%d}],"annotations":[{"id":1,"image_id":1,"track_id":5,"bbox":[1,2,3,4]},{"id":2,"image_id":9,"track_id":5,"bbox":[1,2,3,4]},{"id":3,"image_id":1,"track_id":5,"bbox":[1,2,3]}]}'
    boxes, _ = S.parse_federated(spark.createDataFrame([(doc % (s, s, s + 2, s),) for s in (0, 1)], "value string"))
    assert sorted(map(tuple, boxes.collect())) == [(0, 7, 5, 2, 1.0, 2.0, 3.0, 4.0), (1, 7, 5, 3, 1.0, 2.0, 3.0, 4.0)]
    assert "map_from_entries" not in boxes._jdf.queryExecution().toString()


def test_overlaps_of_masks_are_those_of_their_pixels():
    """Random masks, equal and empty ones, cut anywhere into pieces."""
    r = np.random.default_rng(2)
    mask = lambda: tuple((int(s), int(n)) for s, n in zip(np.arange(0, 300, 10) + r.integers(0, 4, 30), r.integers(1, 7, 30), strict=True) if r.random() < 0.5)
    a, b = [mask() for _ in range(12)] + [()], [mask() for _ in range(9)] + [()]
    b += a[:3]
    pixels = lambda m: {p for s, n in m for p in range(s, s + n)}
    want = [[len(pixels(x) & pixels(y)) / max(1, len(pixels(x) | pixels(y))) for y in b] for x in a]
    for piece in (7, 4096):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(painting, "PIECE", piece)
            assert painting.overlaps(a, b).tolist() == want
    assert painting.overlaps([], b).shape == (0, len(b)) and painting.overlaps([()], [()]).tolist() == [[0.0]]


def test_a_frame_of_many_masks_takes_seconds():
    """1,500 masks of forty runs before and after: run by run, minutes."""
    many = [[{"start": 600 * (15 * (i % 100) + c) + 40 * (i // 100) + c % 5, "length": 30 - c % 7} for c in range(40)] for i in range(1500)]
    state, began = painting._Followed(0.5, 6), time.perf_counter()
    out = [r for f in (1, 2) for i, m in enumerate(many) for r in state.step(f, i, m)] + state.end()
    assert len(out) == 3000 and {t for f, i, t in out if f == 1} == {t for f, i, t in out if f == 2} and time.perf_counter() - began < 30


def test_masks_are_compared_once_however_often_they_meet(spark):
    """Two masks in thirty frames are one comparison; masks that only share columns have no pair."""
    column = lambda x, y: [(x * 100 + y, 20), ((x + 70) * 100 + y, 20)]
    frames = [(0, f, i, column(x, y)) for f in range(30) for i, x, y in ((1, 10, 0), (2, 10, 70))]
    schema = "seq long, frame long, id long, mask array<struct<start:bigint,length:bigint>>"
    left, right = spark.createDataFrame(frames, schema), spark.createDataFrame([(s, f, i + 10, [(a + 5, n) for a, n in m]) for s, f, i, m in frames], schema)
    met = painting.Meetings(left, right, 100)
    rows = sorted((r.frame, r.gid, r.tid, round(r.j, 6)) for r in met.pairs.collect())
    assert rows == sorted((f, i, i + 10, 0.6) for f in range(30) for i in (1, 2))
    assert met.measured(met.pairs, lambda p: p.select("a", "b")).count() == 2
