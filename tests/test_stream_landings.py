"""Landings in time order: micro-batches of one size, whole results when times overlap between shares."""

import pytest
from pyspark.sql import functions as F

from workload import streams

SF = "/root/testdata/sf0.001"
COPIES, LANDED = 3, 5000


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Events repeated with shifted keys; their times start again with every copy."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    size = events.agg(F.max("event_id")).first()[0] + 1
    path = str(tmp_path_factory.mktemp("copies"))
    shifted = F.col("event_id") + F.col("id") * size
    repeated = events.crossJoin(spark.range(COPIES)).withColumn("event_id", shifted).drop("id")
    repeated.write.parquet(f"{path}/events.parquet")
    return path, size * COPIES


@pytest.fixture
def batches(monkeypatch):
    """Input rows of every micro-batch."""
    queries, start = [], streams.sinks.start_table

    def spied(*args):
        queries.append(start(*args))
        return queries[-1]

    monkeypatch.setattr(streams.sinks, "start_table", spied)
    return lambda: [p.numInputRows for q in queries for p in q.recentProgress if p.numInputRows]


def test_stage_latency_batches_of_one_size(spark, copies, batches, monkeypatch):
    monkeypatch.setattr(streams, "LANDED_ROWS", LANDED, raising=False)
    path, frames = copies
    got = streams.stream_stage_latency(spark, path).select("frame", "detect_ms").collect()
    assert sorted(r.frame for r in got) == list(range(frames))
    assert all(r.detect_ms == (4000 + r.frame % 7 * 100) / 1000 for r in got)
    rows = batches()
    assert sum(rows) == streams.V.mrk(spark, path).count() + 1
    assert len(rows) > 3 and max(rows) < 2 * LANDED


def test_windows_in_batches_of_one_size(spark, copies, batches, monkeypatch):
    monkeypatch.setattr(streams, "LANDED_ROWS", 1000, raising=False)
    path, frames = copies
    times = streams._times(spark, path)
    got = streams.stream_output_fps(spark, path).select("stream_id", "window_us", "frames").collect()
    hours = times.groupBy("stream_id", F.expr("ts_us - ts_us % 3600000000")).count().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, hours))
    got = streams.stream_latest_per_tick(spark, path).select("stream_id", "stage", "tick_us", "ts_us").collect()
    stage, tick = F.expr("if(frame % 3 = 0, 'IMAGE', 'DETECT')"), F.expr("ts_us - ts_us % 600000000")
    newest = times.groupBy("stream_id", stage, tick).agg(F.max("ts_us")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, newest))
    rows = batches()
    assert sum(rows) == 2 * (frames + 1) and len(rows) > 6 and max(rows) < 2000
