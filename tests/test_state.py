"""Keyed state, joins, timing and predictions on hand-written rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightlake.constants import HEAD_CLASS_COUNTS, HEADS
from sightlake.operators import keyed as K, messages as M, predictions as P, timing as T


def test_first_and_last_wins(spark, rows):
    data = [(0, 1, 3, "c", None), (0, 1, 1, "a", 7), (0, 1, 2, "b", 8), (1, 1, 9, "z", 1)]
    df = spark.createDataFrame(data, "stream_id int, frame long, arrival_seq long, v string, n int")
    for n in (1, 4):  # the result does not depend on partitioning
        assert rows(K.first_wins(df.repartition(n))) == [(0, 1, 1, "a", 7), (1, 1, 9, "z", 1)]
        assert rows(K.last_wins(df.repartition(n))) == [(0, 1, 3, "c", None), (1, 1, 9, "z", 1)]


def test_retain(spark, rows):
    data = [(0, "a", 1), (0, "b", 2), (0, "c", 3), (0, "a", 4), (1, "x", 1)]
    df = spark.createDataFrame(data, "stream_id int, frame string, arrival_seq long")
    assert rows(K.retain_newest(df, 2)) == [(0, "a", 4), (0, "c", 3), (1, "x", 1)]
    assert rows(K.retain_newest(df, 2, refresh=False)) == [(0, "a", 4), (0, "c", 3), (1, "x", 1)]


def test_retain_returning_keys(spark, rows):
    """Against a store that is replayed put by put."""
    rng = np.random.default_rng(3)
    data = [(s, int(k), i) for s in (0, 1, 2) for i, k in enumerate(rng.integers(0, 40 if s else 6, 400))]
    df = spark.createDataFrame(data, "stream_id int, frame long, arrival_seq long")
    for n in (1, 7, 30, 50):
        want = []
        for s in (0, 1, 2):
            store = {}
            for _, k, at in (d for d in data if d[0] == s):
                if k not in store and len(store) == n:
                    del store[next(iter(store))]
                store[k] = at
            want += [(s, k, at) for k, at in store.items()]
        assert rows(K.retain_newest(df, n, refresh=False)) == sorted(want, key=repr)


def test_group_limit_covers_large_stores(spark):
    df = spark.range(100_000).selectExpr("id % 3 AS stream_id", "id AS frame", "id AS arrival_seq")
    plan = K.retain_newest(df, 4096)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_one_shot_matching(spark, rows):
    meta = spark.createDataFrame([(0, "D", 5, 1, "old"), (0, "D", 5, 20, "late"), (0, "D", 5, 21, "last")],
                                 "stream_id int, stage string, buf_key long, arrival_seq long, log string")
    pay = spark.createDataFrame([(0, "D", 5, 10, 100), (0, "D", 5, 11, 101), (0, "D", 5, 21, 102), (0, "D", 5, 30, 103)],
                                "stream_id int, stage string, buf_key long, arrival_seq long, n_bytes long")
    assert rows(K.join_payloads(meta, pay).select("log", "n_bytes")) == [("last", 102), ("old", 100)]


def test_matching_equals_a_loop(spark, rows):
    """Single, repeated and hot keys, NULL streams and NULL keys, against one pass in arrival order."""
    import random

    rng = random.Random(5)
    puts, sent, want = [], [], []
    waiting = {}
    for at in range(3000):
        key = rng.choice([(0, 7), (0, 7), (0, at), (None, at % 40), (1, at % 90), (1, None)])
        if rng.random() < 0.5:
            puts.append((*key, at, f"m{at}"))
            waiting[key] = f"m{at}"
        else:
            sent.append((*key, at, at))
            want.append((*key, at, waiting.pop(key, None) if key[1] is not None else None))
    meta = spark.createDataFrame(puts, "stream_id int, buf_key int, arrival_seq long, log string")
    pay = spark.createDataFrame(sent, "stream_id int, buf_key int, arrival_seq long, n_bytes long")
    keys = ("stream_id", "buf_key")
    for limit in (30, 10**6):
        got = K.join_payloads(meta, pay, keys, require_metadata=False, hot_rows=limit)
        assert rows(got.select(*keys, "arrival_seq", "log")) == sorted(want, key=repr)
    single = K.join_payloads(meta.filter("arrival_seq < 1"), pay.filter("arrival_seq < 1"), keys)
    assert single.count() == 0 and "Window" not in single._jdf.queryExecution().toString()


def test_inherit(spark, rows):
    captured = spark.createDataFrame(
        [(0, 1, 1, "ntp", 10), (0, 1, 2, "ref", 20), (0, 2, 3, "none", None)],
        "stream_id int, frame long, arrival_seq long, source string, ts_ns long")
    asked = spark.createDataFrame(
        [(0, 1, 5, "pts", 1), (0, 2, 6, "pts", 2), (0, 3, 8, "pts", 4), (0, 3, 7, "buf_pts", 3)],
        "stream_id int, frame long, arrival_seq long, source string, ts_ns long")
    got = K.inherit_timestamps(asked, captured).select("frame", "arrival_seq", "source", "ts_ns")
    # a captured "none" also counts; an uncaptured frame keeps its first fallback
    assert rows(got) == [(1, 5, "ntp", 10), (2, 6, "none", None), (3, 7, "buf_pts", 3), (3, 8, "buf_pts", 3)]


def test_payloads(spark, rows):
    meta = spark.createDataFrame(
        [(0, "D", 5, 1, "old"), (0, "D", 5, 2, "new"), (0, "D", None, 3, "nokey"), (0, "D", 6, 4, "unused")],
        "stream_id int, stage string, buf_key long, arrival_seq long, log string")
    pay = spark.createDataFrame(
        [(0, "D", 5, 10, 100), (0, "D", 5, 11, 101), (0, "D", None, 12, 102), (0, "D", 9, 13, 103)],
        "stream_id int, stage string, buf_key long, arrival_seq long, n_bytes long")
    assert rows(K.join_payloads(meta, pay).select("buf_key", "log", "n_bytes")) == [(5, "new", 100)]
    loose = K.join_payloads(meta, pay, require_metadata=False).select("buf_key", "log", "n_bytes")
    assert rows(loose) == sorted([(5, "new", 100), (5, None, 101), (9, None, 103), (None, None, 102)], key=repr)
    latest = K.latest_metadata(pay, meta, "log").select("arrival_seq", "latest_log")
    assert rows(latest) == [(n, "unused") for n in (10, 11, 12, 13)]


def test_latency(spark, rows):
    marks = [(0, 1, "mux", 1000, 1), (0, 1, "infer", 5260, 2), (0, 1, "assessment", 12840, 3), (0, 1, "mux", 990, 4),
             (0, 2, "mux", 10, 1), (0, 2, "infer", 5, 2), (0, 3, "infer", 5, 2), (0, 3, "assessment", 7, 3), (0, 4, "mux", 1, 1)]
    df = spark.createDataFrame(marks, "stream_id int, frame long, stage string, t_us long, arrival_seq long")
    got = T.stage_latency(T.pivot_stages(df)).select("frame", "detect_ms", "assess_ms")
    # a repeated mark overwrites; the negative span is zero; missing sides stay unknown
    assert rows(got) == [(1, 4.27, 7.58), (2, 0.0, None), (3, None, 0.002), (4, None, None)]


def test_averages(spark, rows):
    full = {"mux": 0, "infer": 4, "assessment": 9, "convert": 10, "osd": 12, "sink": 15}
    short = {"mux": 0, "infer": 6, "convert": 7, "osd": 8, "sink": 9}
    marks = [(0, f, s, t * 1000, 1) for f, stages in ((1, full), (2, short), (3, {"mux": 0, "sink": 3})) for s, t in stages.items()]
    marks += [(1, 1, s, t * 1000, 1) for s, t in short.items()]
    df = spark.createDataFrame(marks, "stream_id int, frame long, stage string, t_us long, arrival_seq long")
    got = {r.stream_id: r for r in T.stage_averages(T.pivot_stages(df)).collect()}
    assert (got[0].n, got[0].detect_ms, got[0].assess_ms, got[0].convert_ms, got[0].total_ms) == (2, 5.0, 5.0, 1.0, 12.0)
    assert got[0].detect_fps == pytest.approx(200.0)
    assert (got[1].n, got[1].assess_ms, got[1].assess_fps) == (1, None, None)


def tensors(spark, *layers):
    data = [(0, 1, o, i, n, l, g) for o, i, n, l, g in layers]
    return spark.createDataFrame(
        data, "stream_id int, frame long, object_id int, layer_index int, layer_name string, logits array<double>, producer_id int")


def test_predictions(spark):
    df = tensors(
        spark,
        (0, 0, "out", [1.0, 1.0], 2),                       # by position, tie: first class
        (0, 2, "person_type", [0.0, 3.0, 99.0], 2),         # by name, cut to two classes
        (0, 5, "person_type", [5.0, 0.0], 2),               # a later layer of the same head wins
        (0, 6, "person_type", [], 2),                       # but not with nothing in it
        (0, 9, "out", [1.0], 2),                            # no head at that position
        (0, 4, "out", [1.0], 2),                            # fewer logits than classes
        (1, 0, "out", [1.0, 2.0], 1),                       # other producer
        (2, 8, "nothing", [1.0], 2),
    )
    got = {r.object_id: r.predictions for r in P.predict_objects(df).collect()}
    assert set(got) == {0}
    p = {h: tuple(v) for h, v in got[0].items()}
    assert set(p) == {HEADS[0], "person_type", HEADS[4]}
    assert p[HEADS[0]] == (0, 0.5, [0.5, 0.5])
    assert p["person_type"][0] == 0 and len(p["person_type"][2]) == 2
    assert p[HEADS[4]] == (0, 1.0, [1.0])


def test_head_weights_are_checked():
    good = {h: np.zeros((n, 4)) for h, n in HEAD_CLASS_COUNTS.items()}
    bias = {h: np.zeros(n) for h, n in HEAD_CLASS_COUNTS.items()}
    assert P.HeadWeights(good, bias)(np.ones((3, 4))).shape == (3, 19)
    with pytest.raises(KeyError, match="trauma_head"):
        P.HeadWeights({h: w for h, w in good.items() if h != "trauma_head"}, bias)
    with pytest.raises(ValueError, match="expected 2"):
        P.HeadWeights({**good, "person_type": np.zeros((3, 4))}, {**bias, "person_type": np.zeros(3)})


def test_messages(spark, rows):
    objects = """array(named_struct('object_index', 0, 'object_id', 4, 'bbox', array(1D, 2D, 4D, 6D), 'class_name', CAST(NULL AS STRING),
      'confidence', CAST(NULL AS DOUBLE), 'predictions', map('b', named_struct('class_id', 0, 'confidence', 1D, 'probabilities', array(1D)))))"""
    df = spark.range(2).selectExpr(
        "0 AS stream_id", "id AS frame", "id AS data_source_id", "id + 1500000000 AS timestamp_ns", "'X' AS stage",
        f"CASE WHEN id = 0 THEN {objects} ELSE filter({objects}, o -> false) END AS objects")
    boxes = M.target_box_arrays(df).selectExpr("frame", "stamp.sec", "stamp.nanosec", "inline_outer(uav_target_boxes)")
    got = rows(boxes.select("frame", "sec", "nanosec", "center_x", "center_y", "detection_class", "detection_confidence"))
    assert got == [(0, 1, 500000000, 3.0, 5.0, "person", 0.0), (1, 1, 500000001, None, None, None, None)]
    people = M.casualty_messages(df, p=M.Publisher(frame_id="cam"))
    assert rows(people.select("frame", "object_id", "bbox_x", "position_frame_id", "annotations.field_name")) == [
        (0, 4, 1.0, "cam", ["clip_rgb_b"])]
    assert M.route(df).count() == 0
    audit = M.publish_audit(spark.createDataFrame([("a", 1, 5), ("a", 0, 6), ("b", 1, 1)], "topic string, messages int, n_bytes long"))
    assert rows(audit) == [("a", 2, 1, 11), ("b", 1, 1, 1)]


def test_recording(spark, tmp_path, rows):
    a = spark.range(2).selectExpr("0 AS stream_id", "id AS frame", "named_struct('sec', id, 'nanosec', 0) AS stamp", "'x' AS format")
    path = str(tmp_path / "bag")
    M.write_recording(M.recording({"image": a, "casualty": a.drop("format").withColumn("extra", F.lit(1))}), path)
    back = spark.read.parquet(path)
    assert rows(back.select("topic", "frame", "message")) == [
        ("casualty", 0, '{"extra":1}'), ("casualty", 1, '{"extra":1}'), ("image", 0, '{"format":"x"}'), ("image", 1, '{"format":"x"}')]


def test_metadata_with_stage_times(spark):
    """Detector times only in detect records; frames without marks have none."""
    from sightlake.plans.detect import timed_metadata
    from sightlake.operators import records as R

    from workload import views as V

    frames = V.frm(spark, "/root/testdata/sf0.001").filter("frame < 3")
    empty = R.detect_frames(frames, V.det(spark, "/root/testdata/sf0.001").filter("false").withColumn("object_id", F.lit(0)))
    marks = [(f % 4, f, ms, 5.0) for f, ms in ((0, 4.0), (1, 0.0))]
    times = spark.createDataFrame(marks, "stream_id int, frame long, detect_ms double, assess_ms double")
    got = {r.frame: (r.timing, r.log_text) for r in timed_metadata(empty, times, "DETECT").collect()}
    assert got[0][0] == ["detect_ms=4.00", "detect_fps=250.00"] and " detect_ms=4.00 detect_fps=250.00 source=" in got[0][1]
    assert got[1][0] == ["detect_ms=0.00"]
    assert got[2][0] == [] and "_ms=" not in got[2][1]
    both = {r.frame: r.timing for r in timed_metadata(empty.withColumn("objects", F.expr(
        "cast(array() as array<struct<object_id:int,bbox:array<double>,labels:array<string>>>)")), times, "ASSESS").collect()}
    assert both[0] == ["detect_ms=4.00", "detect_fps=250.00", "assess_ms=5.00", "assess_fps=200.00"]
