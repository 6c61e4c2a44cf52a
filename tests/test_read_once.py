"""Inputs of several readers are computed once, small packet files share tasks."""

import json

import pytest
from pyspark.sql import functions as F

from sightlake.operators import sampling as S
from sightlake.plans import wire as W
from sightlake.sources import packets as K
from workload import streams, views as V

SF = "/root/testdata/sf0.001"


@pytest.fixture
def counted(spark):
    """counted(df, column) -> (df whose evaluations of the column are counted, the counter)"""
    def add(df, column):
        seen = spark.sparkContext.accumulator(0)

        def see(value):
            seen.add(1)
            return value

        return df.withColumn(column, F.udf(see, df.schema[column].dataType).asNondeterministic()(column)), seen

    return add


def test_small_files_share_tasks(spark, tmp_path, rows):
    df = spark.range(3000).select(
        F.to_json(F.struct(F.col("id").alias("frame"))).alias("metadata"), F.col("id").cast("string").cast("binary").alias("payload"))
    path = str(tmp_path / "out")
    K.write_packets(df.repartition(3), path, roll_bytes=200)
    assert len(list((tmp_path / "out").iterdir())) > 200
    back = K.read_packets(spark, path)
    assert back.rdd.getNumPartitions() == 1
    assert rows(back.select("metadata", F.col("payload").cast("string"))) == rows(df.select("metadata", F.col("payload").cast("string")))
    heads = K.read_packets(spark, path, payload=False)
    assert heads.groupBy("path").agg((F.max("seq") + 1 == F.count("*")).alias("whole")).filter("NOT whole").isEmpty()
    assert heads.select(K.load_payload("path", "offset", "n_bytes").alias("p")).distinct().count() == 3000


def test_parts_fill_up_to_the_limit():
    part = K.CapturePart("a")
    sizes = lambda found, split: [len(g.parts) for g in K.packed([(part, n) for n in found], split)]
    mib = 2**20
    assert sizes([mib] * 10, 256 * mib) == [4, 4, 2]
    assert sizes([mib] * 6400, 256 * mib) == [64] * 100
    assert sizes([300 * mib, mib, mib, 300 * mib], 256 * mib) == [1, 2, 1]
    assert sizes([mib] * 4, mib // 2) == [1] * 4 and sizes([], mib) == []


@pytest.mark.parametrize("stage,publish", [
    ("IMAGE", W.publish_packets), ("DETECT", W.publish_targets), ("ASSESS", lambda p: W.publish_log(p, 50, "received"))])
def test_packets_are_parsed_once(spark, counted, stage, publish):
    heads = [(i % 2, i, i * 10, json.dumps({"stage": stage, "frame": i, "timestamp_ns": i, "objects": []}), bytes(i)) for i in range(40)]
    df = spark.createDataFrame(heads, "stream_id int, arrival_seq long, received long, metadata string, payload binary")
    df, seen = counted(df, "metadata")
    assert publish(df).count() > 0
    assert seen.value == 40


def test_sampled_frames_are_read_twice(spark, counted, rows):
    data = [(f % 3, f, i, f * 400_000) for f in range(60) for i in range(3)]
    df, seen = counted(spark.createDataFrame(data, "stream_id int, frame long, arrival_seq long, ts_us long"), "ts_us")
    assert S.interval_sample_frames(df, 2_000_000).select("frame").distinct().count() == 30
    assert seen.value <= 2 * len(data)


def test_fork_numbers_boxes_once(spark, counted, monkeypatch, rows):
    boxes, seen = counted(V.det(spark, SF), "confidence")
    n = boxes.count()
    seen.value = 0
    monkeypatch.setattr(V, "det", lambda *args: boxes)
    got = dict(r[:2] for r in rows(streams.stream_fork_outputs(spark, SF)))
    assert got["IMAGE"] == got["DETECT"] == V.frm(spark, SF).count()
    assert seen.value == n
