import random

import pytest
from pyspark.sql import functions as F

from sightlake.operators import dense_times as D, sampling as S


def loop(data, interval):
    out, last = [], {}
    for s, a, t in sorted(data, key=lambda r: (r[0], r[2], r[1])):
        if s not in last or t - last[s] >= interval:
            last[s] = t
            out.append((s, a, t))
    return sorted(out, key=repr)


def times(kind, n, rnd):
    if kind == "steady":
        return [i * 33_333 for i in range(n)]
    if kind == "bursts":
        return [rnd.randrange(20) * 1_000_000 + rnd.randrange(50_000) for _ in range(n)]
    if kind == "ties":
        return [rnd.randrange(40) * 250_000 for _ in range(n)]
    return [rnd.randrange(-5 * 10**6, 10**9) for _ in range(n)]


@pytest.mark.parametrize("interval,chunk", [(1_000_000, 4), (250_000, 1), (7_777_777, 3)])
def test_equals_loop(spark, rows, monkeypatch, interval, chunk):
    monkeypatch.setattr(S, "RUN_CHUNKS", 3)
    rnd = random.Random(interval)
    kinds = ["steady", "bursts", "ties", "sparse"] * 3
    data = [(s, i, t) for s, kind in enumerate(kinds) for i, t in enumerate(sorted(times(kind, 300, rnd)))]
    df = spark.createDataFrame(data, "stream_id int, arrival_seq long, ts_us long").repartition(3)
    got = S.interval_sample(df, interval, chunk_intervals=chunk).select("stream_id", "arrival_seq", "ts_us")
    assert rows(got) == loop(data, interval)


@pytest.mark.parametrize("interval", [250_000, 1_000_000, 7_777_777])
def test_dense_way_equals_loop(spark, rows, interval):
    rnd = random.Random(interval)
    data = [(s, i, t) for s, kind in enumerate(["steady", "bursts", "ties", "sparse"])
            for i, t in enumerate(sorted(times(kind, 200, rnd)))] + [(9, 0, -7), (8, 0, 5), (8, 1, 5 + interval)]
    distinct = spark.createDataFrame(sorted({(s, t) for s, _, t in data}), "stream_id int, t long").repartition(3)
    want = [(s, t) for s, _, t in loop(data, interval)]
    for walk_links in (1, 12):
        assert rows(D.emitted_times(distinct, interval, ["stream_id"], walk_links)) == sorted(set(want), key=repr)


def test_dense_streams_leave_the_chunks(spark, rows, monkeypatch):
    monkeypatch.setattr(S, "INTERVAL_ROWS", 50)
    rnd = random.Random(5)
    calm = [(0, i, i * 400_000) for i in range(60)]
    crowded = [(1, i, t) for i, t in enumerate(sorted(rnd.randrange(9 * 10**6) for _ in range(2_000)))]
    data = calm + crowded + [(2, 0, None), (0, 60, None)]
    df = spark.createDataFrame(data, "stream_id int, arrival_seq long, ts_us long")
    assert rows(S.dense_streams(df, 1_000_000).table) == [(1,)]
    assert rows(S.interval_sample(df, 1_000_000)) == loop(calm + crowded, 1_000_000)


def test_a_million_times_in_an_interval(spark, rows, monkeypatch):
    """Nanosecond times of which chunk edges in doubles would be wrong."""
    monkeypatch.setattr(D, "WALK_LINKS", 100_000)
    start, interval = 1_700_000_000_000_000_000, 1_000_000_000
    df = spark.range(2_500_000).select(
        F.lit(3).alias("stream_id"), F.col("id").alias("arrival_seq"), (F.col("id") * 977 + start).alias("ts_us"))
    step = -(-interval // 977)
    want = [(3, i, start + i * 977) for i in range(0, 2_500_000, step)]
    assert rows(S.interval_sample(df, interval)) == sorted(want, key=repr)


def test_special_intervals(spark, rows):
    df = spark.createDataFrame([(0, 0, 0), (0, 1, 10), (0, 2, 19), (0, 3, 20)], "stream_id int, arrival_seq long, ts_us long")
    assert S.interval_sample(df, -1).count() == 0
    assert S.interval_sample(df, 0).count() == 4
    assert [r[2] for r in rows(S.interval_sample(df, 10).select("stream_id", "arrival_seq", "ts_us"))] == [0, 10, 20]


def test_frames_stay_whole(spark, rows):
    data = [(0, f, i, f * 400_000) for f in range(10) for i in range(3)]
    df = spark.createDataFrame(data, "stream_id int, frame long, arrival_seq long, ts_us long")
    got = S.interval_sample_frames(df, 1_000_000).groupBy("frame").count()
    assert rows(got) == [(0, 3), (3, 3), (6, 3), (9, 3)]


def test_latest_per_tick(spark, rows):
    data = [(0, "D", 5, 0), (0, "D", 9, 1), (0, "D", 9, 2), (0, "D", 12, 3), (1, "D", 3, 4)]
    df = spark.createDataFrame(data, "stream_id int, stage string, ts_us long, arrival_seq long")
    assert rows(S.latest_per_tick(df, 10)) == [(0, "D", 0, 9, 2), (0, "D", 10, 12, 3), (1, "D", 0, 3, 4)]
