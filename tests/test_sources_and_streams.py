import pytest
from pyspark.sql import functions as F

from trackloom.sources import mot as M
from trackloom.streaming import rules as R
from trackloom.operators import filters as O


def test_box_text_round_trip(spark, tmp_path):
    gt = tmp_path / "s1" / "gt"
    gt.mkdir(parents=True)
    (gt / "gt.txt").write_text("1,1,10,20,30,40,-1\n1 2 5 5 10 10 0.5 3 0.7\n2,1,1\n\n2, 1, 11, 20, 30, 40, 1, 2\n")
    (tmp_path / "s1" / "seqinfo.ini").write_text("[Sequence]\nname=s1\nframeRate=25\nimWidth=640\n")
    boxes = M.read_boxes(spark, f"{tmp_path}/*/gt/gt.txt", conf_default=0.9).orderBy("frame", "id")
    got = [(r.seq, r.frame, r.id, r.conf, r.cls, r.visibility) for r in boxes.collect()]
    assert got == [("s1", 1, 1, 0.9, None, None), ("s1", 1, 2, 0.5, 3, "0.7"), ("s1", 2, 1, 1.0, 2, None)]
    assert M.filter_rows(boxes, keep={2}).count() == 2  # the row without a class passes
    assert M.to_corners(boxes, keep={2}).count() == 1  # here it counts as class 0
    info = M.read_seqinfo(spark, f"{tmp_path}/*/seqinfo.ini").first()
    assert info.seq == "s1" and info.info == {"name": "s1", "frameRate": "25", "imWidth": "640"}
    assert [r.seq for r in M.discover(spark, str(tmp_path)).collect()] == ["s1"]
    t = spark.createDataFrame([("s1", 1, 3, 1.0, 2.0, 3.0, 4.0, 0.5), ("s1", 1, -1, 1.0, 2.0, 3.0, 4.0, 0.5)], "seq string, frame int, id int, x double, y double, w double, h double, score double")
    M.write_tracks(t, f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").first().value == "1,3,1.0,2.0,3.0,4.0,0.50,-1,-1,-1"


def test_stride_rounds_halves_to_even(spark):
    r = spark.range(1).select(M.stride(F.lit(25.0), F.lit(10.0)).alias("a"), M.stride(F.lit(0.0), F.lit(10.0)).alias("b"), M.stride(F.lit(5.0), F.lit(10.0)).alias("c")).first()
    assert tuple(r) == (2, 3, 1)


def test_vehicle_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<sequence><frame num="1"><target_list><target id="7"><box left="1" top="2" width="3" height="4"/><attribute vehicle_type="Bus"/></target><target id="8"><box left="5" top="2" width="3" height="4"/><attribute vehicle_type="ufo"/></target></target_list></frame></sequence>')
    got = M.read_vehicle_xml(spark, f"{tmp_path}/a.xml", {"car": 1, "bus": 2}).orderBy("id").collect()
    assert [(r.frame, r.id, r.x, r.cls) for r in got] == [(1, 7, 1.0, 2), (1, 8, 5.0, 4)]


def test_frame_tables_are_numbered_densely(spark, tmp_path):
    for n in (3, 10):
        (tmp_path / f"f_{n:04d}.csv").write_text("classID,trackID,x,y,w,h\n1,5,1,2,3,4\nx,y,,,,\n")
    got = M.read_frame_tables(spark, str(tmp_path)).orderBy("frame").collect()
    assert [(r.frame, r.id) for r in got] == [(1, 5), (2, 5)]


def test_frame_out_of_range_fails(spark):
    boxes = spark.createDataFrame([("a", 5)], "seq string, frame int")
    meta = spark.createDataFrame([("a", 4)], "seq string, seq_length int")
    with pytest.raises(Exception, match="out of range"):
        M.check_frames(boxes, meta).collect()


def _stream(spark, tmp_path, df, schema, name):
    path = f"{tmp_path}/{name}"
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def _run(stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    assert q.awaitTermination(60)


def test_debounce_stream_equals_batch(spark, tmp_path):
    e = spark.createDataFrame([(k, 10**12 + t) for k in (1, 2) for t in (0, 400, 1000, 1900, 2000, 3100)], "user_id long, ms long").withColumn("ts", F.timestamp_millis("ms"))
    t = e.drop("ms")
    _run(R.debounced(_stream(spark, tmp_path, t, t.schema, "a"), "user_id", 1000, "1 minute", 60_000), "deb")
    got = sorted(tuple(r) for r in spark.table("deb").collect())
    want = sorted((r.user_id, r.ms) for r in O.spaced(e, ["user_id"], "ms", 1000).collect())
    assert got == want == [(k, 10**12 + t) for k in (1, 2) for t in (0, 1000, 2000, 3100)]


def test_door_stream(spark, tmp_path):
    e = spark.createDataFrame([(1, 10**12 + t, v) for t, v in ((1, 90.0), (2, 50.0), (3, 10.0), (4, 95.0))], "door long, ms long, value double").select("door", F.timestamp_millis("ms").alias("ts"), "value")
    _run(R.door_states(_stream(spark, tmp_path, e, e.schema, "d"), "door", "1 minute", 60_000), "doors")
    assert sorted((r.ms - 10**12, r.change) for r in spark.table("doors").collect()) == [(3, "open>closed"), (4, "closed>open")]


def test_windows_sessions_and_joins_stream(spark, tmp_path):
    e = spark.createDataFrame([("a", f"2024-01-01 00:0{m}:00", float(m)) for m in (0, 1, 2, 9)], "k string, t string, value double").select("k", F.to_timestamp("t").alias("ts"), "value")
    batch = sorted((str(r.start), r.n) for r in R.period_counts(e, ["k"], "5 minutes", "1 minute").collect())
    _run(R.period_counts(_stream(spark, tmp_path, e, e.schema, "w"), ["k"], "5 minutes", "1 minute"), "w", "complete")
    assert sorted((str(r.start), r.n) for r in spark.table("w").collect()) == batch == [("2024-01-01 00:00:00", 3), ("2024-01-01 00:05:00", 1)]
    assert sorted((r.n, r.seconds) for r in R.sessions(e, ["k"], "3 minutes", "1 minute").collect()) == [(1, 180), (3, 300)]
    _run(R.appearances(_stream(spark, tmp_path, e, e.schema, "p"), ["k"], "1 minute"), "first")
    assert spark.table("first").count() == 1
    hits = R.trigger_presence(e.filter("value = 9"), e.filter("value < 9"), "k", "8 minutes", "0 minutes", "1 minute")
    assert hits.filter("presence is not null").count() == 2
