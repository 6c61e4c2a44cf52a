"""Edge rows of the column functions."""

import datetime as dt
import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sightlake.constants import HEADS
from sightlake.functions import clock, geometry, identity, tensors, text

NTP = 2_208_988_800 * 10**9


def one(spark, schema, data, *cols):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*cols).collect()]


def test_ntp_and_resolution(spark):
    data = [(0, 5, None, 9), (-1, None, 0, 9), (NTP, None, None, None), (NTP + 1, 7, 1, 1),
            (None, None, None, 0), (None, None, None, -1), (None, NTP + 3, None, None)]
    got = one(spark, "ntp_raw long, ref_raw long, buf_pts long, pts long", data, clock.resolve_timestamp().alias("t"))
    assert [tuple(t[0]) for t in got] == [
        ("ref", 5), ("buf_pts", 0), ("ntp", NTP), ("ntp", 1), ("pts", 0), ("none", None), ("ref", 3)]


def test_timestamp_text(spark):
    at = int(dt.datetime(2024, 5, 1, 22, 46, 20, 242000, dt.timezone.utc).timestamp()) * 10**9 + 242 * 10**6
    data = [("ref", at), ("pts", 1_500_000_000), ("ntp", None), ("buf_pts", 0), ("ntp", at + 757_999_700)]
    got = one(spark, "source string, ts long", data, clock.format_timestamp("source", "ts"))
    def expected(source, ns):
        if ns is None:
            return "NONE"
        if source in ("ntp", "ref"):
            return dt.datetime.fromtimestamp(ns / 1e9, tz=dt.timezone.utc).strftime("%H:%M:%S.%f")[:-3] + "Z"
        return f"{ns / 1e9:.3f}s"
    assert [g[0] for g in got] == [expected(*d) for d in data]
    assert got[0][0] == "22:46:20.242Z"


def test_stamp_floors(spark):
    data = [(0,), (999_999_999,), (1_000_000_000,), (-1,), (None,)]
    got = one(spark, "ts long", data, clock.stamp("ts").alias("s"))
    assert [tuple(g[0]) for g in got] == [(0, 0), (0, 999_999_999), (1, 0), (-1, 999_999_999), (None, None)]


def test_message_timestamp(spark):
    data = [("12", None, 1), (" 12 ", None, 1), ("1_000", None, 1), ("1.5", "7", 1), ("x", None, 1),
            (None, "8", 1), ("-3", "8", 1), ("1__0", "9", 1), ("99999999999999999999", "4", 1)]
    got = one(spark, "a string, b string, now long", data, clock.message_timestamp("a", "b", "now"))
    assert [g[0] for g in got] == [12, 12, 1000, 7, 1, 8, -3, 9, 4]


def test_rates(spark):
    data = [(None,), (0.0,), (-1.0,), (4.26,), (7.58,)]
    got = one(spark, "ms double", data, text.fixed(clock.rate_from_ms("ms"), 2), clock.rate_from_seconds("ms"))
    assert [g[0] for g in got] == [None, None, None, "234.74", "131.93"]
    assert [g[1] for g in got][:3] == [0.0, 0.0, 0.0]


def test_ids_and_keys(spark):
    data = [("7", 1), ("bad", 1), (None, None), (None, 2147483646), (None, 2147483647), (None, -1)]
    got = one(spark, "id string, frame long", data, identity.data_source_id("id", "frame"))
    assert [g[0] for g in got] == [7, 0, 0, 2147483646, 0, 2147483646]
    data = [(5, 6), (-1, 6), (None, 0), (-1, -1), (0, None)]
    assert [g[0] for g in one(spark, "p long, d long", data, identity.buffer_key("p", "d"))] == [5, 6, 0, None, 0]


def test_scale(spark):
    data = [(10.0, 20.0, 30.0, 40.0, 1920, 1080)]
    schema = "left double, top double, width double, height double, src_w int, src_h int"
    scaled = geometry.scale_bbox(geometry.bbox(), img_w=F.lit(640), img_h=F.lit(368))
    assert one(spark, schema, data, scaled)[0][0] == [10 * (640 / 1920), 20 * (368 / 1080), 30 * (640 / 1920), 40 * (368 / 1080)]
    for bad in ((0, 1080), (1920, -1)):
        with pytest.raises(PySparkException, match="must be positive"):
            one(spark, schema, [data[0][:4] + bad], scaled)


def _ramp(c, low):
    mid = (low + 0.8) / 2
    if c <= low:
        return (1.0, 0.0, 0.0, 1.0)
    if c < mid:
        return (1.0, (c - low) / max(mid - low, 1e-6), 0.0, 1.0)
    if c < 0.8:
        return (1.0 - (c - mid) / max(0.8 - mid, 1e-6), 1.0, 0.0, 1.0)
    return (0.0, 1.0, 0.0, 1.0)


@pytest.mark.parametrize("low", [0.2, 0.5, 0.8, 0.9])
def test_color(spark, low):
    values = [low, low + 1e-9, (low + 0.8) / 2, 0.8, 0.95, 0.1, 0.3, 0.65]
    got = one(spark, "c double", [(v,) for v in values], geometry.confidence_color("c", low))
    assert [tuple(g[0]) for g in got] == [_ramp(v, low) for v in values]


def test_overlay(spark):
    data = [(0.5, 2.5, 2.0, 3.0, 0), (100.4, 90.6, 10.0, 10.0, 2160)]
    schema = "left double, top double, width double, height double, h int"
    got = one(spark, schema, data, geometry.overlay_segments(geometry.bbox()), geometry.overlay_label(geometry.bbox(), "h"))
    assert [tuple(s) for s in got[0][0]] == [(0, 2, 2, 2), (2, 2, 2, 6), (2, 6, 0, 6), (0, 6, 0, 2)]
    assert tuple(got[0][1]) == (0, 0, 1)
    assert tuple(got[1][1]) == (99, 91 - 18, 2)


def test_input_size(spark):
    data = [(1920, 1080, 640), (1920, 1080, 1920), (1080, 1920, 640), (640, 480, 20), (30, 20, 33)]
    got = one(spark, "w int, h int, s int", data, geometry.model_input_size("w", "h", "s"))
    assert [tuple(g[0]) for g in got] == [(640, 384), (1920, 1088), (384, 640), (32, 32), (64, 32)]


doubles = st.one_of(
    st.floats(min_value=-1e6, max_value=1e6, allow_nan=False),
    st.integers(-10**6, 10**6).map(lambda n: n / 8), st.integers(-10**6, 10**6).map(lambda n: n / 1000),
    st.integers(-10**5, 10**5).map(lambda n: n / 100 + 0.005),
)


@settings(max_examples=3, deadline=None)
@given(st.lists(doubles, min_size=300, max_size=400))
def test_fixed_text(spark, values):
    values += [0.5, 1.5, 2.5, 0.125, 0.375, 2.675, 1.005, -0.001, -0.0, 0.0, 1e-300, 1.2345e9, 4503599627.115]
    got = one(spark, "x double", [(v,) for v in values], *[text.fixed("x", d) for d in (0, 2, 3)])
    assert got == [(f"{v:.0f}", f"{v:.2f}", f"{v:.3f}") for v in values]


def test_element_count(spark):
    data = [(0, [2, 3, 4]), (5, [2]), (None, []), (-1, [0, 7])]
    got = one(spark, "n int, d array<long>", data, tensors.element_count("n", "d"))
    assert [g[0] for g in got] == [24, 5, 1, 0]


def test_decode(spark):
    half = struct.pack("<3e", 1.0, -2.0, math.inf)
    data = [
        (np.array([1.5, -2.0], "<f4").tobytes(), "FLOAT", 2), (half, "HALF", 3),
        (np.array([7, -9], "<i4").tobytes(), "INT32", 2), (np.array([1, -1, 5], "i1").tobytes(), "INT8", 2),
        (b"1234", "UINT8", 4), (None, "FLOAT", 2), (b"", "FLOAT", 0), (np.array([3.0], "<f4").tobytes(), "FLOAT", 1),
    ]
    got = one(spark, "b binary, t string, n long", data, tensors.decode_tensor("b", "t", "n"))
    assert [g[0] for g in got] == [[1.5, -2.0], [1.0, -2.0, math.inf], [7.0, -9.0], [1.0, -1.0], [], [], [], [3.0]]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(st.floats(-50, 50), max_size=5), min_size=20, max_size=40))
def test_softmax(spark, logits):
    for values, (probabilities, top) in zip(logits, one(
        spark, "l array<double>", [(v,) for v in logits], tensors.softmax("l"), tensors.argmax(tensors.softmax("l"))
    )):
        if not values:
            assert probabilities == []
            continue
        exps = [math.exp(v - max(values)) for v in values]
        assert probabilities == pytest.approx([e / sum(exps) for e in exps], rel=1e-12)
        assert sum(probabilities) == pytest.approx(1.0)
        assert top == max(range(len(values)), key=lambda i: probabilities[i])


def test_labels(spark):
    data = [("trauma_head", 0), ("trauma_head", 2), ("trauma_head", 3), ("person_type", 1), ("other", 4)]
    got = one(spark, "h string, c int", data, tensors.label_text("h", "c"))
    assert [g[0] for g in got] == ["head-", "trauma_head=class2", "head?", "human", "other=class4"]


def prediction_row(spark, classes):
    entries = [f"'{h}', named_struct('class_id', {c}, 'confidence', 0.75D, 'probabilities', array(0.25D, 0.75D))"
               for h, c in classes.items()]
    return spark.range(1).select(F.expr(f"map({', '.join(entries)})").alias("p"), F.lit(1).alias("id"))


def test_label_lines(spark):
    classes = dict(zip(HEADS, (0, 0, 0, 1, 1, 1, 2, 1)))
    lines = text.label_lines("id", tensors.labels_of("p"))
    got = prediction_row(spark, classes).select(lines.alias("l")).select("l", text.label_log("l")).first()
    assert got[0] == ["person 1 injuries:", "human  hem-  resp-", "head-  torso+", "upper+  lower+  eyes_nt"]
    assert got[1] == "person 1 injuries: | human  hem-  resp- | head-  torso+ | upper+  lower+  eyes_nt"
    few = prediction_row(spark, {"trauma_torso": 1}).select(lines).first()[0]
    assert few == ["person 1 injuries:", "torso+"]


def test_log_rows(spark):
    box = F.array(*[F.lit(v) for v in (1278.0, 358.4, 362.5, 128.0)])
    got = spark.range(1).select(
        text.detect_row(F.lit(0), box, F.lit(0.875)), text.assess_row(F.lit(0), box, F.array(F.lit("a"), F.lit("b")))
    ).first()
    assert tuple(got) == ("object=0 bbox=1278,358,362,128 person_conf=0.88", "object=0 bbox=1278,358,362,128 a | b")


def test_timing_fields(spark):
    data = [(4.26, 7.58), (None, 7.58), (0.0, None), (None, None)]
    got = one(spark, "d double, a double", data, F.array_join(text.timing_fields("d", "a"), " "))
    assert [g[0] for g in got] == [
        "detect_ms=4.26 detect_fps=234.74 assess_ms=7.58 assess_fps=131.93", "assess_ms=7.58 assess_fps=131.93",
        "detect_ms=0.00", ""]


def test_annotations_and_defaults(spark):
    p = F.expr("""map('b', named_struct('class_id', 1, 'confidence', 0.5D, 'probabilities', array(0.5D)),
      'a', named_struct('class_id', 2, 'confidence', 0.25D, 'probabilities', CAST(array() AS array<double>)),
      'c', named_struct('class_id', CAST(NULL AS INT), 'confidence', CAST(NULL AS DOUBLE), 'probabilities', CAST(NULL AS array<double>)))""")
    df = spark.range(1).select(p.alias("p"))
    listed = df.select(tensors.annotations("p")).first()[0]
    assert [(a.field_name, a.observation) for a in listed] == [
        ("clip_rgb_a", [2.0, 0.25]), ("clip_rgb_b", [0.5]), ("clip_rgb_c", [-1.0, 0.0])]
    full = df.select(tensors.complete_predictions("p")).first()[0]
    assert tuple(full["c"]) == (-1, 0.0, [])


def test_normalisation(spark):
    got = spark.range(1).select(
        tensors.normalize_channels(F.array(*[F.lit(255.0)] * 3), F.lit(1)), tensors.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))),
        tensors.l2_normalize(F.array(F.lit(0.0))),
    ).first()
    assert got[0] == pytest.approx([(1 - 0.48145466) / 0.26862954, (1 - 0.4578275) / 0.26130258, (1 - 0.40821073) / 0.27577711])
    assert got[1] == [0.6, 0.8] and got[2] == [0.0]
