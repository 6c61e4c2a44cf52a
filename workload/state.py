"""Queries over keyed state, timing marks and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightlake.constants import STAGES
from sightlake.functions import clock, text
from sightlake.operators import keyed as K, sampling as S, timing as T
from sightlake.plans import detect as detect_plan

from . import views as V
from .frames import LOGTXT, NUM, OBJ, TSR, TXT, detect_records
from .registry import query
from .views import ARR, DET, FRM, MRK, PAY

KEYS = ["stream_id", "frame"]


def greedy(source: str, interval: int) -> str:
    """SQL for greedy sampling: the next emitted time is the first one at least an interval later."""
    return f"""nxt AS (SELECT stream_id, ts_us, min(ts_us) OVER (PARTITION BY stream_id ORDER BY ts_us
  RANGE BETWEEN {interval} FOLLOWING AND UNBOUNDED FOLLOWING) AS next_us FROM {source}),
g(stream_id, ts_us) AS (SELECT stream_id, min(ts_us) FROM {source} GROUP BY stream_id
  UNION ALL SELECT g.stream_id, n.next_us FROM g JOIN nxt n ON n.stream_id = g.stream_id AND n.ts_us = g.ts_us WHERE n.next_us IS NOT NULL)"""


@query("first_wins", ARR, sql="""SELECT stream_id, frame, min(arrival_seq) AS arrival_seq, arg_min(event_us, arrival_seq) AS event_us,
  arg_min(source, arrival_seq) AS source, arg_min(val, arrival_seq) AS val FROM arr GROUP BY stream_id, frame""")
def first_wins(spark, sf):
    return K.first_wins(V.arr(spark, sf))


@query("last_wins", ARR, sql="""SELECT stream_id, frame, max(arrival_seq) AS arrival_seq, arg_max(event_us, arrival_seq) AS event_us,
  arg_max(source, arrival_seq) AS source, arg_max(val, arrival_seq) AS val FROM arr GROUP BY stream_id, frame""")
def last_wins(spark, sf):
    return K.last_wins(V.arr(spark, sf))


@query("retain_newest", ARR, """l AS (SELECT stream_id, frame, max(arrival_seq) AS arrival_seq, arg_max(val, arrival_seq) AS val FROM arr GROUP BY ALL)""",
       sql="""SELECT stream_id, frame, arrival_seq, val FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY arrival_seq DESC) AS rn FROM l) WHERE rn <= 512""")
def retain_newest(spark, sf):
    return K.retain_newest(V.arr(spark, sf).select(*KEYS, "arrival_seq", "val"), 512)


@query("timestamp_inherit", FRM, ARR, TSR, """stored AS (SELECT stream_id, frame, source, ts_ns FROM tsr WHERE frame % 3 <> 0),
brought AS (SELECT stream_id, frame, arg_min(source, arrival_seq) AS source, arg_min(event_us, arrival_seq) * 1000 AS ts_ns FROM arr GROUP BY ALL)""",
       sql="""SELECT a.stream_id, a.frame, a.arrival_seq, CASE WHEN s.frame IS NOT NULL THEN s.source ELSE b.source END AS source,
  CASE WHEN s.frame IS NOT NULL THEN s.ts_ns ELSE b.ts_ns END AS ts_ns
  FROM arr a JOIN brought b USING (stream_id, frame) LEFT JOIN stored s USING (stream_id, frame)""")
def timestamp_inherit(spark, sf):
    captured = V.frm(spark, sf).filter(F.col("frame") % 3 != 0).select(
        *KEYS, "arrival_seq", clock.resolve_timestamp().alias("t")
    ).select(*KEYS, "arrival_seq", "t.*")
    rows = V.arr(spark, sf).select(*KEYS, "arrival_seq", "source", (F.col("event_us") * 1000).alias("ts_ns"))
    return K.inherit_timestamps(rows, captured)


@query("payload_asof", FRM, PAY, """put AS (SELECT stream_id, frame, arrival_seq FROM frm WHERE frame % 6 < 3)""",
       sql="""SELECT p.stream_id, p.arrival_seq, p.n_bytes, f.frame AS latest_frame FROM pay p ASOF LEFT JOIN put f
  ON p.stream_id = f.stream_id AND p.arrival_seq >= f.arrival_seq""")
def payload_asof(spark, sf):
    puts = V.frm(spark, sf).filter(F.col("frame") % 6 < 3).select(*KEYS, "arrival_seq")
    payloads = V.pay(spark, sf).select("stream_id", "arrival_seq", "n_bytes")
    return K.latest_metadata(payloads, puts, "frame", ["stream_id"])


@query("interval_sample", FRM, """t AS (SELECT stream_id, frame, unix_ns // 1000 AS ts_us FROM frm)""",
       greedy("t", 3_600_000_000), recursive=True,
       sql="SELECT t.stream_id, t.frame, t.ts_us FROM t JOIN g ON t.stream_id = g.stream_id AND t.ts_us = g.ts_us")
def interval_sample(spark, sf):
    rows = V.frm(spark, sf).select(*KEYS, "arrival_seq", F.expr("unix_ns div 1000").alias("ts_us"))
    return S.interval_sample(rows, 3_600_000_000).select(*KEYS, "ts_us")


@query("interval_sample_dense", FRM, """t AS (SELECT stream_id, frame, unix_ns // 1000 AS ts_us FROM frm)""",
       greedy("t", 43_200_000_000), recursive=True,
       sql="SELECT t.stream_id, t.frame, t.ts_us FROM t JOIN g ON t.stream_id = g.stream_id AND t.ts_us = g.ts_us")
def interval_sample_dense(spark, sf):
    """Two samples a day of streams that count as dense from 16 rows in an interval on."""
    rows = V.frm(spark, sf).select(*KEYS, "arrival_seq", F.expr("unix_ns div 1000").alias("ts_us"))
    dense = S.dense_streams(rows, 43_200_000_000, limit=16)
    return S.interval_sample(rows, 43_200_000_000, dense=dense).select(*KEYS, "ts_us")


@query("interval_sample_frames", FRM, DET, """rows_at AS (SELECT stream_id, frame, det_order, unix_ns // 1000 AS ts_us FROM det JOIN frm USING (stream_id, frame)),
t AS (SELECT stream_id, frame, min(ts_us) AS ts_us FROM rows_at GROUP BY ALL)""",
       greedy("t", 7_200_000_000), recursive=True,
       sql="""SELECT r.stream_id, r.frame, r.det_order, r.ts_us FROM rows_at r JOIN t USING (stream_id, frame)
  JOIN g ON t.stream_id = g.stream_id AND t.ts_us = g.ts_us""")
def interval_sample_frames(spark, sf):
    times = V.frm(spark, sf).select(*KEYS, "arrival_seq", F.expr("unix_ns div 1000").alias("ts_us"))
    rows = V.det(spark, sf).select(*KEYS, "det_order").join(times, KEYS)
    return S.interval_sample_frames(rows, 7_200_000_000).select(*KEYS, "det_order", "ts_us")


@query("latest_per_tick", FRM, """t AS (SELECT stream_id, frame, unix_ns // 1000 AS ts_us, CASE WHEN frame % 3 = 0 THEN 'IMAGE' ELSE 'DETECT' END AS stage FROM frm)""",
       sql="""SELECT stream_id, stage, ts_us - ts_us % 60000000 AS tick_us, arg_max(frame, ts_us) AS frame, max(ts_us) AS ts_us FROM t GROUP BY 1, 2, 3""")
def latest_per_tick(spark, sf):
    rows = V.frm(spark, sf).select(
        *KEYS, "arrival_seq", F.expr("unix_ns div 1000").alias("ts_us"),
        F.when(F.col("frame") % 3 == 0, "IMAGE").otherwise("DETECT").alias("stage"),
    )
    return S.latest_per_tick(rows, 60_000_000).select("stream_id", "stage", "tick_us", "frame", "ts_us")


@query("stage_pivot", MRK, sql="""SELECT stream_id, frame, mux, infer, assessment, "convert", osd, sink FROM wide""")
def stage_pivot(spark, sf):
    return T.pivot_stages(V.mrk(spark, sf)).select(*KEYS, *STAGES)


LAT = """lat AS (SELECT stream_id, frame,
    CASE WHEN infer IS NOT NULL AND mux IS NOT NULL THEN greatest(0.0::DOUBLE, (infer - mux - off) / 1000.0::DOUBLE) END AS detect_ms,
    CASE WHEN infer IS NOT NULL AND assessment IS NOT NULL THEN greatest(0.0::DOUBLE, (assessment - infer) / 1000.0::DOUBLE) END AS assess_ms
  FROM (SELECT *, CASE WHEN frame % 6 = 0 THEN 5000 ELSE 0 END AS off FROM wide))"""


def stage_latencies(spark, sf):
    # every sixth frame starts late, so some detections end before their start
    late = F.when(F.col("frame") % 6 == 0, 5000).otherwise(0)
    return T.stage_latency(T.pivot_stages(V.mrk(spark, sf)).withColumn("mux", F.col("mux") + late))


@query("stage_latency", MRK, LAT, sql="""SELECT stream_id, frame, detect_ms, assess_ms, CASE WHEN detect_ms > 0 THEN 1000.0::DOUBLE / detect_ms END AS detect_fps,
  CASE WHEN assess_ms > 0 THEN 1000.0::DOUBLE / assess_ms END AS assess_fps FROM lat""")
def stage_latency(spark, sf):
    return stage_latencies(spark, sf).select(*KEYS, "detect_ms", "assess_ms", "detect_fps", "assess_fps")


@query("timing_fields", MRK, LAT, sql="""SELECT stream_id, frame, concat_ws(' ', 'detect_ms=' || printf('%.2f', detect_ms), 'detect_fps=' || printf('%.2f', CASE WHEN detect_ms > 0 THEN 1000.0::DOUBLE / detect_ms END),
  'assess_ms=' || printf('%.2f', assess_ms), 'assess_fps=' || printf('%.2f', CASE WHEN assess_ms > 0 THEN 1000.0::DOUBLE / assess_ms END)) AS fields FROM lat""")
def timing_fields(spark, sf):
    return stage_latencies(spark, sf).select(
        *KEYS, F.array_join(text.timing_fields("detect_ms", "assess_ms"), " ").alias("fields")
    )


@query("stage_averages", MRK, """d AS (SELECT stream_id, sink - sink % 86400000000 AS window_us, infer - mux AS detect, assessment - infer AS assess,
    "convert" - COALESCE(assessment, infer) AS conv, osd - "convert" AS osd, sink - osd AS snk, sink - mux AS total
  FROM wide WHERE mux IS NOT NULL AND infer IS NOT NULL AND "convert" IS NOT NULL AND osd IS NOT NULL AND sink IS NOT NULL)""",
       sql="""SELECT stream_id, window_us, count(*) AS n, round(avg(detect) / 1000.0::DOUBLE, 6) AS detect_ms, round(1.0::DOUBLE / (avg(detect) / 1e6), 6) AS detect_fps,
  round(avg(assess) / 1000.0::DOUBLE, 6) AS assess_ms, round(1.0::DOUBLE / (avg(assess) / 1e6), 6) AS assess_fps, round(avg(conv) / 1000.0::DOUBLE, 6) AS convert_ms,
  round(avg(osd) / 1000.0::DOUBLE, 6) AS osd_ms, round(avg(snk) / 1000.0::DOUBLE, 6) AS sink_ms, round(avg(total) / 1000.0::DOUBLE, 6) AS total_ms FROM d GROUP BY stream_id, window_us""")
def stage_averages(spark, sf):
    """Averages per day of sink time: marks are hours apart in the table, so 10 s windows would hold one frame each."""
    means = T.stage_averages(T.pivot_stages(V.mrk(spark, sf)), seconds=86_400)
    plain = ("stream_id", "window_us", "n")
    return means.select(*plain, *[F.round(c, 6).alias(c) for c in means.columns if c not in plain])


@query("output_fps", FRM, sql="""SELECT stream_id, window_us, count(*) AS frames, count(*) / 3600.0::DOUBLE AS fps FROM (
  SELECT stream_id, unix_ns // 1000 - (unix_ns // 1000) % 3600000000 AS window_us FROM frm) GROUP BY stream_id, window_us""")
def output_fps(spark, sf):
    frames = V.frm(spark, sf).withColumn("ts_us", F.expr("unix_ns div 1000"))
    return T.output_fps(frames, "ts_us", seconds=3600)


@query("output_fps_reports", FRM, """t AS (SELECT stream_id, frame, unix_ns // 1000 AS ts_us, row_number() OVER (PARTITION BY stream_id ORDER BY arrival_seq) AS n FROM frm)""",
       greedy("t", 3_600_000_000),
       """r AS (SELECT t.stream_id, t.ts_us, n, lag(t.ts_us) OVER w AS since, lag(n) OVER w AS seen, row_number() OVER w AS k
  FROM t JOIN g ON t.stream_id = g.stream_id AND t.ts_us = g.ts_us WINDOW w AS (PARTITION BY t.stream_id ORDER BY t.ts_us))""", recursive=True,
       sql="""SELECT stream_id, ts_us, n - CASE WHEN k = 2 THEN 0 ELSE seen END AS frames,
  (n - CASE WHEN k = 2 THEN 0 ELSE seen END) / ((ts_us - since) / 1e6::DOUBLE) AS fps FROM r WHERE since IS NOT NULL""")
def output_fps_reports(spark, sf):
    frames = V.frm(spark, sf).select("stream_id", "arrival_seq", F.expr("unix_ns div 1000").alias("ts_us"))
    return T.reported_fps(frames, 3_600_000_000)


@query("timed_metadata", FRM, DET, MRK, LAT, NUM, OBJ, TSR, TXT, LOGTXT, """clock AS (SELECT stream_id, frame, concat_ws(' ', 'detect_ms=' || printf('%.2f', detect_ms),
    'detect_fps=' || printf('%.2f', CASE WHEN detect_ms > 0 THEN 1000.0::DOUBLE / detect_ms END)) AS fields FROM lat)""",
       sql="""SELECT stream_id, frame, object_count, COALESCE(fields, '') AS timing, body AS rows_text,
  replace(log_text, ' source=' || src_w || 'x', COALESCE(' ' || nullif(fields, ''), '') || ' source=' || src_w || 'x') AS log_text
  FROM meta LEFT JOIN clock USING (stream_id, frame) LEFT JOIN (SELECT stream_id, frame, body FROM agg) USING (stream_id, frame)""")
def timed_metadata(spark, sf):
    """Detect records with the times of their stages in the record, its rows and its log text."""
    made = detect_plan.timed_metadata(detect_records(spark, sf), stage_latencies(spark, sf), "DETECT")
    rows = F.array_join(F.transform("rows", lambda row: F.concat(F.lit("  "), row)), "\n")
    return made.select(
        *KEYS, F.col("object_count").cast("bigint").alias("object_count"), F.array_join("timing", " ").alias("timing"),
        F.when(F.size("rows") > 0, rows).alias("rows_text"), "log_text",
    )
