"""Groups of any size: the second way must equal the plain one."""

import random

from pyspark.sql import Window as W, functions as F

from sightlake.operators import detections as D, records as R, suppression as S
from sightlake.skew import (
    bucketed_last_before, bucketed_row_number, find_hot_keys, group_row_number, no_hot_keys, sliced_row_number,
)


def boxes(spark, seed=1, frames=6, hot=120):
    rnd, out = random.Random(seed), []
    for frame in range(frames):
        for i in range(hot if frame == 2 else rnd.randrange(0, 8)):
            out.append((frame % 2, frame, i, rnd.randrange(2), rnd.randrange(40) * 5.0, rnd.randrange(30) * 5.0,
                        rnd.randrange(1, 12) * 8.0, rnd.randrange(1, 12) * 8.0, rnd.randrange(100) / 100))
    rnd.shuffle(out)
    return spark.createDataFrame(
        out, "stream_id int, frame long, det_order int, class_id int, left double, top double, width double, height double, confidence double"
    ).repartition(5)


def test_find_hot_keys(spark, rows):
    df = boxes(spark)
    assert not find_hot_keys(df, ["frame"], 120).present
    hot = find_hot_keys(df, ["frame"], 119)
    assert hot.present and hot.small and rows(hot.table) == [(2,)]
    assert hot.only(df).count() + hot.exclude(df).count() == df.count()


def test_row_numbers(spark, rows):
    df = boxes(spark).select("stream_id", "frame", "det_order")
    keys, order = ["stream_id", "frame"], [F.col("det_order")]
    plain = rows(df.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint")))
    hot = find_hot_keys(df, keys, 50)
    assert hot.present
    cols = [*df.columns, "rn"]
    assert rows(group_row_number(df, keys, order, "rn", hot).select(*cols)) == plain
    assert rows(group_row_number(df, keys, order, "rn").select(*cols)) == plain
    assert rows(sliced_row_number(df, keys, order, "rn").select(*cols)) == plain
    assert rows(bucketed_row_number(df, keys, "det_order", "rn", width=7).select(*cols)) == plain


def test_last_before(spark, rows):
    rnd = random.Random(3)
    puts = [(s, a, f"v{s}-{a}") for s in (0, 1) for a in sorted(rnd.sample(range(5, 300), 40))]
    probes = [(s, a, a * 10) for s in (0, 1, 2) for a in range(0, 300, 3)]
    p = spark.createDataFrame(probes, "s int, a long, extra long")
    m = spark.createDataFrame(puts, "s int, a long, v string")
    expected = []
    for s, a, extra in probes:
        seen = [x for x in puts if x[0] == s and x[1] <= a]
        expected.append((s, a, extra, max(seen, key=lambda x: x[1])[2] if seen else None))
    for width in (4, 50, 100_000):
        got = bucketed_last_before(p, m, ["s"], "a", "v", width).select("s", "a", "extra", "latest_v")
        assert rows(got) == sorted(expected, key=repr)


def greedy(dets, iou):
    groups, kept = {}, []
    for d in dets:
        groups.setdefault((d[0], d[1], d[3]), []).append(d)
    for group in groups.values():
        chosen = []
        for d in sorted(group, key=lambda d: (-d[8], d[2])):
            def above(k):
                x = min(k[4] + k[6], d[4] + d[6]) - max(k[4], d[4])
                y = min(k[5] + k[7], d[5] + d[7]) - max(k[5], d[5])
                return x > 0 and y > 0 and x * y / (k[6] * k[7] + d[6] * d[7] - x * y) > iou
            if not any(above(k) for k in chosen):
                chosen.append(d)
        kept += chosen
    return sorted(kept, key=repr)


def test_suppression_both_ways(spark, rows):
    df = boxes(spark, seed=5)
    expected = greedy([tuple(r) for r in df.collect()], 0.45)
    assert 0 < len(expected) < df.count()
    plain = S.suppress(df, hot=no_hot_keys(["frame"]))
    assert rows(plain) == expected
    hot = find_hot_keys(df, ["stream_id", "frame", "class_id"], 20)
    assert hot.present
    for block in (1, 7, 1000):
        if block == 1:
            few = df.filter("frame != 2 OR det_order < 6")
            want = greedy([tuple(r) for r in few.collect()], 0.45)
            some = find_hot_keys(few, ["stream_id", "frame", "class_id"], 1)
            assert rows(S.suppress(few, hot=some, block=1)) == want
        else:
            assert rows(S.suppress(df, hot=hot, block=block)) == expected
    assert rows(S.suppress(plain, hot=no_hot_keys(["frame"]))) == expected  # idempotent


def test_suppression_cases(spark, rows):
    schema = "stream_id int, frame long, det_order int, class_id int, left double, top double, width double, height double, confidence double"
    def run(*b):
        data = [(0, 0, i, 0, *x) for i, x in enumerate(b)]
        return [r[2] for r in rows(S.suppress(spark.createDataFrame(data, schema), hot=no_hot_keys(["frame"])))]
    # B is suppressed by A, so C, which only overlaps B, survives
    assert run((0.0, 0.0, 10.0, 10.0, 0.9), (3.0, 0.0, 10.0, 10.0, 0.8), (6.0, 0.0, 10.0, 10.0, 0.7)) == [0, 2]
    # equal scores: list position decides
    assert run((0.0, 0.0, 10.0, 10.0, 0.5), (1.0, 0.0, 10.0, 10.0, 0.5)) == [0]
    # IoU of exactly 0.45 stays: 9 of 20 cells shared
    assert run((0.0, 0.0, 20.0, 1.0, 0.9), (0.0, 0.0, 9.0, 1.0, 0.8)) == [0, 1]
    assert run((0.0, 0.0, 20.0, 1.0, 0.9), (0.0, 0.0, 10.0, 1.0, 0.8)) == [0]
    # boxes without area never suppress
    assert run((0.0, 0.0, 0.0, 10.0, 0.9), (0.0, 0.0, 0.0, 10.0, 0.8)) == [0, 1]


def test_top_k(spark, rows):
    data = [(0, 0, i, 0, 0.5 if i % 2 else 0.9) for i in range(301)]
    df = spark.createDataFrame(data, "stream_id int, frame long, det_order int, class_id int, confidence double")
    assert D.top_k(df).count() == 300
    assert [r[2] for r in rows(D.top_k(df, k=2))] == [0, 2]


def test_person_numbers(spark, rows):
    data = [(0, 1, 0, 1, 0), (0, 1, 1, 0, 0), (0, 1, 2, 0, 8), (0, 1, 3, 2, 5), (0, 1, 4, 0, None), (0, 2, 0, 1, 1), (0, 3, 0, 0, 1)]
    df = spark.createDataFrame(data, "stream_id int, frame long, det_order int, class_id int, stored int")
    got = D.number_persons(df, stored_id="stored").select("frame", "det_order", "ordinal", "object_id")
    assert rows(got) == [(1, 1, 0, 0), (1, 2, 1, 7), (1, 4, 2, 2), (3, 0, 0, 0)]


def test_oversized_frame_is_one_record(spark, rows):
    """A frame above the limit and above a slice has the same single record."""
    df = boxes(spark, seed=9)
    frames = spark.createDataFrame([(f % 2, f) for f in range(8)], "stream_id int, frame long")
    hot = find_hot_keys(df, ["stream_id", "frame"], 50)

    def records(hot, size):
        nested = R.nest_objects(df, ["det_order", "confidence"], hot=hot, slice_objects=size)
        return R.attach_objects(frames, nested, hot=hot)

    plain, sliced = records(no_hot_keys(["frame"]), 4096), records(hot, 16)
    assert rows(sliced.selectExpr("stream_id", "frame", "object_count", "to_json(objects)")) == rows(
        plain.selectExpr("stream_id", "frame", "object_count", "to_json(objects)")
    )
    assert sliced.count() == 8
    assert sliced.filter("frame = 2").selectExpr("object_count", "size(objects)").first()[:] == (120, 120)
    assert sliced.filter("frame = 7").selectExpr("object_count", "size(objects)").first()[:] == (0, 0)


def test_suppression_of_one_huge_group(spark):
    """Dense piles, chains of overlaps and sizes from tiny to huge, against one greedy pass."""
    import numpy as np

    r = np.random.default_rng(4)
    left = np.r_[r.uniform(0, 500, 1400), r.normal(50, 2, 600), np.arange(120) * 9.0]
    top = np.r_[r.uniform(0, 500, 1400), r.normal(50, 2, 600), np.full(120, 2000.0)]
    size = np.r_[np.exp(r.uniform(0, 5, 1400)), r.uniform(20, 30, 600), np.full(120, 20.0)]
    score = np.round(np.r_[r.uniform(0, 1, 2000), np.arange(120) / 200], 2)
    n = len(left)
    data = [(0, 1, 0, i, *map(float, (left[i], top[i], size[i], size[i] * 1.1, score[i]))) for i in range(n)]
    df = spark.createDataFrame(data, "stream_id int, frame long, class_id int, det_order int, left double, top double, width double, height double, confidence double")
    order = np.lexsort((np.arange(n), -score))
    x, y, w, h = left[order], top[order], size[order], size[order] * 1.1
    for iou in (0.45, 0.0):
        kept: list[int] = []
        for i in range(n):
            k = np.array(kept, int)
            a = np.minimum(x[i] + w[i], x[k] + w[k]) - np.maximum(x[i], x[k])
            b = np.minimum(y[i] + h[i], y[k] + h[k]) - np.maximum(y[i], y[k])
            if not ((a > 0) & (b > 0) & (a * b / (w[i] * h[i] + w[k] * h[k] - a * b) > iou)).any():
                kept.append(i)
        got = sorted(r.det_order for r in S.suppress(df, iou).select("det_order").collect())
        assert got == sorted(order[kept].tolist())
