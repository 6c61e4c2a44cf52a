import json
import struct

from pyspark.sql import functions as F

from sightlake.operators import catalog as C
from sightlake.sources import lookups as L, packets as K


def record(meta, payload):
    head = json.dumps(meta).encode()
    return struct.pack(">II", len(head), len(payload)) + head + payload


def test_scan(spark, tmp_path, rows):
    first, second = record({"frame": 1}, b"abc"), record({"frame": 2}, b"")
    (tmp_path / "a.packets").write_bytes(first + second + record({"frame": 3}, b"0123456789")[:-1])
    (tmp_path / "b.packets").write_bytes(b"")
    (tmp_path / "c.packets").write_bytes(first[:6])
    (tmp_path / "d.packets").write_bytes(record({"frame": 4, "log_text": "é"}, b"z"))
    (tmp_path / "ignored.txt").write_bytes(first)
    got = K.read_packets(spark, str(tmp_path)).select("seq", F.get_json_object("metadata", "$.frame"), "payload")
    assert rows(got) == [(0, "1", bytearray(b"abc")), (0, "4", bytearray(b"z")), (1, "2", bytearray(b""))]
    heads = K.read_packets(spark, str(tmp_path), payload=False)
    assert heads.filter("payload IS NOT NULL").count() == 0
    later = heads.select("seq", F.get_json_object("metadata", "$.frame"), K.load_payload("path", "offset", "n_bytes"))
    assert rows(later) == rows(got)


def test_round_trip(spark, tmp_path, rows):
    df = spark.range(500).select(
        F.to_json(F.struct(F.col("id").alias("frame"), F.lit("ü").alias("log_text"))).alias("metadata"),
        F.when(F.col("id") % 5 != 0, F.col("id").cast("string").cast("binary")).alias("payload"))
    path = str(tmp_path / "out")
    K.write_packets(df.repartition(3), path, roll_bytes=2000)
    files = list((tmp_path / "out").iterdir())
    assert len(files) > 6 and all(f.name.endswith(".packets") for f in files)
    back = K.parse_metadata(K.read_packets(spark, path))
    assert back.count() == 500 and back.select("frame").distinct().count() == 500
    assert rows(back.filter("frame IN (0, 7)").select("frame", "log_text", "format", F.col("payload").cast("string"))) == [
        (0, "ü", "jpeg", ""), (7, "ü", "jpeg", "7")]


def test_defaults(spark, rows):
    texts = ['{"stage":"DETECT"}', '{"frame":"12","timestamp_ns":5}', '{"frame":3,"source_timestamp_ns":"9","timestamp_ns":5,"data_source_id":"x"}',
             '{"frame":2147483648,"source_timestamp_ns":1.5}']
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "metadata string, n int")
    got = K.parse_metadata(df).select("n", "frame", "message_ts_ns", "data_source_id", "log_text", F.size("objects"))
    assert rows(got) == [(0, None, None, 0, "metadata=missing", 0), (1, 12, 5, 12, "metadata=missing", 0),
                         (2, 3, 9, 0, "metadata=missing", 0), (3, 2147483648, None, 1, "metadata=missing", 0)]


def test_labels(spark, tmp_path, rows):
    (tmp_path / "labels.txt").write_text("person\ntraffic light\ncar\n\n")
    assert rows(L.read_labels(spark, str(tmp_path / "labels.txt"))) == [(0, "person"), (1, "traffic light"), (2, "car")]
    assert L.detector_labels(spark).count() == 80


def test_registry(spark, tmp_path, rows):
    entries = {"det_640_a": '{"requested_long_side": "640", "source_width": 1920,\n "source_height": 1080, "model_width": 640, "model_height": 384}',
               "det_640_b": "{}", "det_640_c": "{oops", "det_1920_a": '{"requested_long_side": 640}'}
    for name, text in entries.items():
        (tmp_path / f"{name}.meta.json").write_text(text)
    registry = L.read_registry(spark, str(tmp_path))
    assert rows(registry.select("name", "stem", "long_side", "requested_long_side", "model_height")) == sorted([
        ("det_640_a", "det", 640, 640, 384), ("det_640_b", "det", 640, None, None), ("det_640_c", "det", 640, None, None),
        ("det_1920_a", "det", 1920, 640, None)], key=repr)
    requests = spark.createDataFrame(
        [(1, "det", 640, 1920, 1080), (2, "det", 640, 1280, 720), (3, "det", 1920, 1920, 1080), (4, "other", 640, 1, 1)],
        "id int, stem string, long_side int, src_w int, src_h int")
    got = C.match_registry(requests, registry).select("id", "model", "input_w", "input_h")
    assert rows(got) == [(1, "det_640_a", 640, 384), (2, "det_640_b", 640, 384), (3, None, None, None), (4, None, None, None)]


def test_sources(spark, rows):
    raws = ["rtsp://127.0.0.1:8555/cam-a", "RTSPS://host/cam-b", "file:///media/my%20clip.mp4", "streams/demo.mp4",
            "/abs/demo.avi", "https://host/v.mp4", "file:///a+b/../c~d*e.mp4", "/x/./y//z"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    got = [r[1:] for r in rows(C.resolve_sources(df, "/proj").select("i", "uri", "path", "is_rtsp"))]
    assert got == [
        (raws[0], None, True), (raws[1], None, True), ("file:///media/my%20clip.mp4", "/media/my clip.mp4", False),
        ("file:///proj/streams/demo.mp4", "/proj/streams/demo.mp4", False), ("file:///abs/demo.avi", "/abs/demo.avi", False),
        (raws[5], None, False), ("file:///c~d%2Ae.mp4", "/a+b/../c~d*e.mp4", False), ("file:///x/y/z", "/x/./y//z", False)]


def test_codecs(spark, rows):
    caps = ["video/x-h265, a", "video/HEVC", "video/avc1", "video/x-H264", "video/x-vp9", "", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(caps)], "i int, caps string")
    assert rows(C.codec_families(df).select("i", "family")) == list(enumerate(["h265", "h265", "h264", "h264", "encode-h264", "encode-h264"]))


def test_checkpoints(spark, rows):
    data = [
        ("good", "clip_model.visual.transformer.resblocks.0.attn.in_proj_weight", 3072, 1024),
        ("good", "clip_model.visual.transformer.resblocks.1.attn.in_proj_weight", 3072, 1024),
        ("good", "clip_model.visual.transformer.resblocks.1.mlp.c_fc.weight", 4096, 1024),
        ("good", "clip_model.transformer.resblocks.0.attn.in_proj_weight", 2304, 768),
        ("good", "clip_model.visual.positional_embedding", 577, 1024),
        ("good", "heads.trauma_head.weight", 2, 768), ("good", "heads.trauma_head.bias", 2, None),
        ("bad", "heads.trauma_head.weight", 2, 768),
    ]
    df = spark.createDataFrame(data, "ckpt string, key string, dim0 int, dim1 int")
    spec = {r.ckpt: r for r in C.checkpoint_spec(df).collect()}
    assert (spec["good"].visual_layers, spec["good"].transformer_layers, spec["good"].visual_grid) == (2, 1, 24)
    assert (spec["bad"].visual_layers, spec["bad"].visual_grid) == (0, None)
    missing = rows(C.missing_weights(df))
    assert ("bad", "heads.trauma_head.bias") in missing and ("good", "heads.trauma_head.bias") not in missing
    assert len(missing) == 14 + 15
    assert rows(C.head_shapes(df)) == [("bad", "trauma_head", 2, 768), ("good", "trauma_head", 2, 768)]


def test_publishers_by_stage(spark, rows):
    """Each topic takes its own packets; stamps, numbers and bytes are the packet's."""
    from sightlake.plans import wire as W

    box = {"object_id": 3, "bbox": [1, 2, 4, 6], "predictions": {"a": {"class_id": 1, "confidence": 0.5}}}
    heads = [{"stage": "IMAGE", "timestamp_ns": 5}, {"stage": "DETECT", "objects": [box]}, {"stage": "DETECT", "timestamp_ns": 7},
             {"stage": "ASSESS", "timestamp_ns": 9, "objects": [box, {}], "log_text": "two"}, {"stage": "ASSESS"}, {"stage": "X"}]
    df = spark.createDataFrame([(0, i, i * 10, json.dumps(h), bytes(i)) for i, h in enumerate(heads)],
                               "stream_id int, arrival_seq long, received long, metadata string, payload binary")
    assert rows(W.publish_packets(df).select("arrival_seq", "seq")) == [(0, 0)]
    sent = W.publish_targets(df, ingest="received").select("arrival_seq", "seq", "stamp.nanosec", F.octet_length("source_img.data"), F.size("uav_target_boxes"))
    assert rows(sent) == [(1, 0, 10, 1, 1), (2, 1, 7, 2, 0)]
    people = W.publish_casualties(df, ingest="received").select("object_id", "stamp.nanosec", F.octet_length("image.data"), "bbox_width", "annotations")
    assert [r[:4] for r in rows(people)] == [(3, 9, 3, 4.0), (None, 9, 3, 0.0)]
    assert sorted(rows(people)[0][4]) == [("clip_rgb_a", [1.0, 0.5])]
    log = W.publish_log(df, 15, "received").select("arrival_seq", "text")
    assert rows(log) == [(0, "published topic=image messages=1 bytes=0\nmetadata=missing"),
                         (1, "published topic=target_detections messages=1 bytes=1\nmetadata=missing"),
                         (3, "published topic=casualty messages=2 bytes=3\ntwo")]
    assert W.publish_log(df, -1, "received").count() == 0 and W.publish_log(df, 0, "received").count() == 5


def test_indexed_file_is_read_in_parts(spark, tmp_path, rows):
    body = b"".join(record({"frame": i}, bytes([i % 251]) * (i * 37 % 500)) for i in range(400))
    big = tmp_path / "big.packets"
    big.write_bytes(body + record({"frame": 400}, b"0123456789")[:-1])
    (tmp_path / "small.packets").write_bytes(record({"frame": 7}, b"x"))
    path, columns = str(tmp_path), ("path", "seq", "metadata", "payload", "offset", "n_bytes")
    whole = rows(K.read_packets(spark, path, split_bytes=8_000).select(*columns))
    assert len(whole) == 401
    assert K.index_packets(spark, path, split_bytes=8_000) == 1
    parts = K.read_packets(spark, path, split_bytes=8_000)
    assert parts.rdd.getNumPartitions() > 8
    assert rows(parts.select(*columns)) == whole
    assert K.read_packets(spark, path, split_bytes=40_000).rdd.getNumPartitions() in (3, 4)
    assert rows(K.read_packets(spark, path, payload=False, split_bytes=8_000).select("seq", "n_bytes")) == sorted(
        ((r[1], r[5]) for r in whole), key=repr)
    # a file that grew keeps its parts, one that shrank is read whole
    big.write_bytes(body + record({"frame": 400}, b"0123456789"))
    assert K.read_packets(spark, path, split_bytes=8_000).count() == 402
    big.write_bytes(record({"frame": 1}, b"y" * 9_000))
    assert K.read_packets(spark, path, split_bytes=8_000).count() == 2


def test_failed_write_leaves_no_files(spark, tmp_path):
    import pytest

    broken = spark.range(50).select(F.lit("{}").alias("metadata"), F.expr("CASE WHEN id = 49 THEN raise_error('x') ELSE binary('p') END").alias("payload"))
    with pytest.raises(Exception):
        K.write_packets(broken.coalesce(1), str(tmp_path / "out"))
    assert not list(tmp_path.glob("out/*"))
