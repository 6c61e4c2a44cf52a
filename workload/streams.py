"""Streaming queries. The tables are landed as files in arrival order and streamed back."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from sightlake.operators.records import frame_metadata, image_records
from sightlake.plans.assess import assess_records
from sightlake.plans.detect import detect_records
from sightlake.session import materialize, new_path
from sightlake.streaming import operators as S, sinks

from . import views as V
from .registry import query
from .state import LAT, greedy
from .tensors import ALL as FORK
from .views import ARR, FRM, MRK, PAY

KEYS = ["stream_id", "frame"]
BATCHES = 3
LANDED_ROWS = 4_000_000  # about as many in a landing by time, and so in a micro-batch, at every table size
LANDED_FILES = 8  # each of them a range of its own, written by a task
CLOSING = -1  # stream of the row that moves the watermark past everything else


def landings(
    df: DataFrame, arrival: str, times: dict[str, int] | None = None, late: int | None = None
) -> Iterator[DataFrame]:
    """``df`` in successive shares of its arrival numbers, then the closing row.

    ``times`` names columns of the closing row and how far they lie ahead. With ``late``, every
    ``late``-th row lands one share later than its number says, and shares are many files in no order.
    """
    bounds = df.agg(F.max(arrival).alias("last"), *[F.max(c).alias(c) for c in times or {}]).first()
    size = bounds["last"] // BATCHES + 1
    share = F.call_function("div", F.col(arrival), F.lit(size))
    if late:
        share = share + F.when(F.col(arrival) % late == 0, 1).otherwise(0)
    for n in range(BATCHES + bool(late)):
        part = df.filter(share == n)
        yield part.repartition(6, F.hash(arrival)) if late else part
    if times:
        yield closing_row(df, {c: bounds[c] + ahead for c, ahead in times.items()})


def landings_by_time(df: DataFrame, time: str, arrival: str, ahead: int) -> Iterator[DataFrame]:
    """``df`` in landings of about ``LANDED_ROWS`` rows that follow each other in ``time``, then the closing row.

    No landing has a row older than those before it, so a lateness budget of any size drops none. The
    rows are dealt by time once; every landing reads its own share.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, "by-time")
    rows, last = df.agg(F.count("*"), F.max(time)).first()
    shares = rows // LANDED_ROWS + 1
    dealt = df.repartitionByRange(shares * LANDED_FILES, time, arrival)
    share = F.call_function("div", F.spark_partition_id(), F.lit(LANDED_FILES))
    # ranges beyond those asked for, if a session deals more, belong to the last landing
    dealt = dealt.withColumn("share", F.least(share, F.lit(shares - 1)).cast("int"))
    dealt.write.partitionBy("share").parquet(path)
    written = spark.read.schema(dealt.schema).parquet(path)
    for n in range(shares):
        yield written.filter(F.col("share") == n).drop("share")
    yield closing_row(df, {time: last + ahead})


def closing_row(df: DataFrame, values: dict[str, int]) -> DataFrame:
    values = {**values, "stream_id": CLOSING}
    return df.sparkSession.range(1).select(*[
        F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields
    ])


def land(
    df: DataFrame, arrival: str, times: dict[str, int] | None = None, late: int | None = None
) -> DataFrame:
    """Write ``df`` as successive files in arrival order and read it as a stream, a few files a batch."""
    spark = df.sparkSession
    path = new_path(spark, "landing")
    for part in landings(df, arrival, times, late):
        part.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 8).parquet(path)


def finish(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    path = new_path(spark, name)
    sinks.start_table(stream, path, f"{path}-state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(path).filter(F.col("stream_id") != CLOSING)


def staged(spark: SparkSession, parts: Iterable[DataFrame], name: str, transform) -> DataFrame:
    """Like ``land`` and ``finish``, but each landing is processed before the next one arrives, from
    the same checkpoint: state crosses micro-batches however many files a landing has."""
    landing, path = new_path(spark, "landing"), new_path(spark, name)
    for part in parts:
        part.write.mode("append").parquet(landing)
        out = transform(spark.readStream.schema(part.schema).parquet(landing))
        sinks.start_table(out, path, f"{path}-state").awaitTermination()
    return spark.read.schema(out.schema).parquet(path).filter(F.col("stream_id") != CLOSING)


DAY_US = 86_400_000_000
DAY_NS = DAY_US * 1000
# a row that lands one share late is up to two shares of the month's table behind
BUDGET, AFTER_BUDGET_NS, DAY_BUCKET = "21 days", 23 * DAY_NS, 86_400_000


def with_unknown_times(df: DataFrame, ns: str) -> DataFrame:
    """Every ninth row lacks its source time ``ts_ns``; ``ingest_ns`` is known for all."""
    known = F.when(F.col("arrival_seq") % 9 != 4, F.col(ns))
    return df.withColumns({"ts_ns": known, "ingest_ns": F.col(ns)})


@query("stream_first_wins", ARR, sql="""SELECT stream_id, frame, min(arrival_seq) AS arrival_seq,
  arg_min(source, arrival_seq) AS source, arg_min(val, arrival_seq) AS val FROM arr GROUP BY stream_id, frame""")
def stream_first_wins(spark, sf):
    """Puts without known time are placed by their ingestion; a put never wins again while its key is held."""
    numbered = V.arr(spark, sf).withColumn("ns", (F.col("arrival_seq") + 1) * 1_000_000_000).drop("event_us")
    puts = with_unknown_times(numbered, "ns").drop("ns")

    def first(stream):
        return S.first_wins(S.with_event_time(stream, "ts_ns", "60 days", ingest_ns="ingest_ns"), bucket_ms=600_000)

    ahead = {"ts_ns": 90 * DAY_NS, "ingest_ns": 90 * DAY_NS}
    return finish(first(land(puts, "arrival_seq", ahead, late=7)), "first-wins").select(*KEYS, "arrival_seq", "source", "val")


@query("stream_late_drop", ARR, """b AS (SELECT *, arrival_seq // (SELECT max(event_id) // 3 + 1 FROM events) AS batch, event_us - event_us % 3600000000 AS window_us FROM arr),
top AS (SELECT batch, max(event_us) // 1000 * 1000 AS top_us FROM b GROUP BY batch),
mark AS (SELECT b.batch, max(top_us) AS watermark FROM (SELECT DISTINCT batch FROM b) b JOIN top ON top.batch < b.batch GROUP BY b.batch)""",
       sql="""SELECT stream_id, window_us, count(*) AS frames, count(*) / 3600.0::DOUBLE AS fps FROM b LEFT JOIN mark USING (batch)
  WHERE watermark IS NULL OR window_us + 3600000000 > watermark GROUP BY stream_id, window_us""")
def stream_late_drop(spark, sf):
    """Hourly counts with no lateness budget: what arrives after its hour is closed is dropped.

    Each landing is processed before the next one arrives, so the watermark has moved on.
    """
    puts = V.arr(spark, sf).withColumn("ts_ns", F.col("event_us") * 1000).drop("event_us")
    def counts(stream):
        return S.output_fps(S.with_event_time(stream, "ts_ns", "0 seconds"), 3600)

    return staged(spark, landings(puts, "arrival_seq", {"ts_ns": 2 * DAY_NS}), "late-drop", counts)


# puts and payloads share buffer keys of eight frames, so a key comes back again and again
MATCH = """p AS (SELECT stream_id, frame, frame // 8 AS buf_key, arrival_seq, 0 AS side FROM frm WHERE frame % 3 <> 1),
s AS (SELECT stream_id, NULL AS frame, arrival_seq // 8 AS buf_key, arrival_seq, 1 AS side FROM pay WHERE arrival_seq % 2 = 0),
b AS (SELECT * FROM p UNION ALL SELECT * FROM s),
turns AS (SELECT *, coalesce(sum(side) OVER (PARTITION BY stream_id, buf_key ORDER BY arrival_seq, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM b),
m AS (SELECT *, last_value(frame IGNORE NULLS) OVER (PARTITION BY stream_id, buf_key, turn ORDER BY arrival_seq, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS matched FROM turns)"""


@query("stream_payload_join", FRM, PAY, MATCH,
       sql="SELECT m.stream_id, m.matched AS frame, m.buf_key, y.n_bytes FROM m JOIN pay y USING (stream_id, arrival_seq) WHERE side = 1 AND matched IS NOT NULL")
def stream_payload_join(spark, sf):
    """One-shot matching of two streams in one state, keys repeated, files in no order, rows late."""
    key = F.call_function("div", F.col("arrival_seq"), F.lit(8)).alias("buf_key")
    times = V.frm(spark, sf).select("arrival_seq", "unix_ns")
    puts = V.frm(spark, sf).filter("frame % 3 <> 1").select(*KEYS, key, "arrival_seq", "unix_ns")
    sent = V.pay(spark, sf).filter("arrival_seq % 2 = 0").select("stream_id", key, "arrival_seq", "n_bytes").join(times, "arrival_seq")
    landed = puts.withColumn("side", F.lit(0)).unionByName(sent.withColumn("side", F.lit(1)), allowMissingColumns=True)

    def match(stream):
        timed = stream.withColumn("event_time", F.timestamp_micros(F.expr("unix_ns div 1000"))).drop("unix_ns")
        left = timed.filter("side <> 1").drop("side", "n_bytes")
        right = timed.filter("side = 1").drop("side", "frame")
        return S.join_payloads(left, right, ["stream_id"], delay=BUDGET, bucket_ms=DAY_BUCKET)

    ahead = {"unix_ns": AFTER_BUDGET_NS, "side": -2}
    return finish(match(land(landed, "arrival_seq", ahead, late=7)), "payload-join").select(*KEYS, "buf_key", "n_bytes")


@query("stream_stage_latency", MRK, LAT.replace("WHEN frame % 6 = 0 THEN 5000 ELSE 0", "WHEN false THEN 0 ELSE 0"),
       sql="SELECT stream_id, frame, detect_ms, assess_ms FROM lat")
def stream_stage_latency(spark, sf):
    """Landings of one size in time order: a task's memory does not grow with the table."""
    marks = V.mrk(spark, sf).withColumn("ts_ns", F.col("t_us") * 1000)

    def latencies(stream):
        timed = S.stage_latencies(S.with_event_time(stream, "ts_ns", "10 minutes"), "1 minute")
        return timed.select(*KEYS, "detect_ms", "assess_ms")  # the stages that they need are state, not all

    return staged(spark, landings_by_time(marks, "ts_ns", "arrival_seq", DAY_NS), "latency", latencies)


def _times(spark, sf) -> DataFrame:
    return V.frm(spark, sf).select(*KEYS, "arrival_seq", "unix_ns", F.expr("unix_ns div 1000").alias("ts_us"))


@query("stream_interval_sample", FRM, """t AS (SELECT stream_id, frame, unix_ns // 1000 AS ts_us FROM frm)""",
       greedy("t", 3_600_000_000), recursive=True,
       sql="SELECT t.stream_id, t.frame, t.ts_us FROM t JOIN g ON t.stream_id = g.stream_id AND t.ts_us = g.ts_us")
def stream_interval_sample(spark, sf):
    def sample(stream):
        return S.interval_sample(S.with_event_time(stream, "unix_ns", BUDGET), 3_600_000_000, bucket_ms=DAY_BUCKET)

    sampled = finish(sample(land(_times(spark, sf), "arrival_seq", {"unix_ns": AFTER_BUDGET_NS}, late=7)), "sample")
    return sampled.select(*KEYS, "ts_us")


@query("stream_output_fps", FRM, sql="""SELECT stream_id, window_us, count(*) AS frames, count(*) / 3600.0::DOUBLE AS fps FROM (
  SELECT stream_id, unix_ns // 1000 - (unix_ns // 1000) % 3600000000 AS window_us FROM frm) GROUP BY stream_id, window_us""")
def stream_output_fps(spark, sf):
    def counts(stream):
        return S.output_fps(S.with_event_time(stream, "unix_ns", "1 hour"), 3600)

    return staged(spark, landings_by_time(_times(spark, sf), "unix_ns", "arrival_seq", DAY_NS), "fps", counts)


@query("stream_latest_per_tick", FRM, """t AS (SELECT stream_id, frame, unix_ns // 1000 AS ts_us, CASE WHEN frame % 3 = 0 THEN 'IMAGE' ELSE 'DETECT' END AS stage FROM frm)""",
       sql="""SELECT stream_id, stage, ts_us - ts_us % 600000000 AS tick_us, arg_max(frame, ts_us) AS frame, max(ts_us) AS ts_us FROM t GROUP BY 1, 2, 3""")
def stream_latest_per_tick(spark, sf):
    rows = _times(spark, sf).withColumn("stage", F.when(F.col("frame") % 3 == 0, "IMAGE").otherwise("DETECT"))

    def newest(stream):
        ticks = S.latest_per_tick(S.with_event_time(stream, "unix_ns", "1 hour"), "10 minutes")
        return ticks.select("stream_id", "stage", "tick_us", "frame", "ts_us")

    return staged(spark, landings_by_time(rows, "unix_ns", "arrival_seq", DAY_NS), "tick", newest)


@query("stream_fork_outputs", *FORK, sql="""SELECT 'IMAGE' AS branch, count(*) AS frames, CAST(0 AS BIGINT) AS objects FROM frm
  UNION ALL SELECT 'DETECT', (SELECT count(*) FROM frm), (SELECT count(*) FROM num JOIN frm USING (stream_id, frame))
  UNION ALL SELECT 'ASSESS', count(DISTINCT (stream_id, frame)), count(*) FROM aobj""")
def stream_fork_outputs(spark, sf):
    """Images, detections and assessments of one stream of frames, a micro-batch per landing."""
    path, landing = new_path(spark, "fork"), new_path(spark, "landing")
    hot = V.hot_frames(spark, sf)
    # every branch of every micro-batch reads them: numbered once, then filtered as they are read
    boxes, tensors = materialize(V.det(spark, sf, hot), "boxes"), materialize(V.logit(spark, sf), "tensors")
    branches = {
        "IMAGE": image_records,
        "DETECT": lambda df: frame_metadata(detect_records(df, boxes, hot=hot), "DETECT"),
        "ASSESS": lambda df: frame_metadata(assess_records(df, boxes, tensors, hot=hot), "ASSESS"),
    }
    frames = V.frm(spark, sf)
    for part in landings(frames, "arrival_seq"):
        part.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(frames.schema).parquet(landing)
        sinks.start_fork(stream, branches, path, f"{path}-state").awaitTermination()
    out = None
    for name in branches:
        written = spark.read.parquet(f"{path}/{name}")
        one = written.agg(F.count("*").alias("frames"), F.coalesce(F.sum("object_count"), F.lit(0)).alias("objects"))
        one = one.select(F.lit(name).alias("branch"), "frames", "objects")
        out = one if out is None else out.unionByName(one)
    return out


@query("stream_publisher_seq", FRM, sql="SELECT stream_id, frame, row_number() OVER (PARTITION BY stream_id ORDER BY arrival_seq) - 1 AS seq FROM frm")
def stream_publisher_seq(spark, sf):
    rows = with_unknown_times(_times(spark, sf), "unix_ns").drop("unix_ns", "ts_us")

    def number(stream):
        return S.publisher_sequence(S.with_event_time(stream, "ts_ns", BUDGET, ingest_ns="ingest_ns"), bucket_ms=DAY_BUCKET)

    ahead = {"ts_ns": AFTER_BUDGET_NS, "ingest_ns": AFTER_BUDGET_NS}
    return finish(number(land(rows, "arrival_seq", ahead, late=7)), "seq").select(*KEYS, "seq")
