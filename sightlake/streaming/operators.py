"""Streaming forms of the operators.

Event time is the frame's source time at microsecond precision (``event_time``);
exact nanoseconds stay in their own column. Results of a group are emitted once the
watermark has passed it, which makes them independent of how rows fall into micro-batches.
Order-dependent state (``ordered``) is released by timers at the same point.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..constants import FRAME_KEYS, STAGES
from ..functions.clock import event_time
from ..operators.timing import stage_latency
from . import ordered

# event time that is held and sorted at once; results do not depend on it
BUCKET_MS = 10_000


def with_event_time(
    df: DataFrame, ts_ns: str, delay: str, name: str = "event_time", ingest_ns: str | None = None
) -> DataFrame:
    """Event time with a lateness budget; rows later than the budget are dropped by stateful steps.

    Windows drop rows without a time: where the source time may be unknown, give the ingestion
    time's column, which then only places the row (``ts_ns`` itself stays NULL)."""
    times = [event_time(c) for c in (ts_ns, ingest_ns) if c]
    return df.withColumn(name, F.coalesce(*times)).withWatermark(name, delay)


def _per_key(df: DataFrame, keys: Sequence[str], gap: str, time: str, *aggs: Column) -> DataFrame:
    """Aggregate all rows of a key that lie within ``gap`` of each other."""
    return df.groupBy(*keys, F.session_window(time, gap).alias("_session")).agg(*aggs).drop("_session")


def first_wins(
    puts: DataFrame, limit: int = 2048, partition: Sequence[str] = ("stream_id",), keys: Sequence[str] = ("frame",),
    arrival: str = "arrival_seq", time: str = "event_time", bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """First put per key in event time; a key counts as known while it is among its stream's ``limit`` newest
    first puts, however long ago that was."""
    processor = ordered.FirstWins(keys, limit, puts.columns, arrival, bucket_ms, time)
    return ordered.run(puts, partition, processor, puts.schema)


def stage_latencies(
    marks: DataFrame, gap: str, keys: Sequence[str] = FRAME_KEYS, time: str = "event_time"
) -> DataFrame:
    """Stage latencies per frame. State of incomplete frames goes with the watermark."""
    latest = [
        F.max_by("t_us", F.when(F.col("stage") == s, F.col("arrival_seq"))).alias(s) for s in STAGES
    ]
    return stage_latency(_per_key(marks, keys, gap, time, *latest))


def join_payloads(
    metadata: DataFrame, payloads: DataFrame, partition: Sequence[str] = ("stream_id", "stage"), key: str = "buf_key",
    limit: int = 512, arrival: str = "arrival_seq", time: str = "event_time", delay: str = "1 minute",
    bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Match payloads to the metadata put under the same buffer key, one to one in event time.

    Of two streams with the column ``time``: a payload takes the newest put of its key since the
    key's previous payload; only the ``limit`` newest waiting puts of a stream are kept. At equal
    times the arrival number decides, then puts come first. Columns of both: the payload's, and the
    put's without ``time``, its arrival as ``metadata_seq``. Rows without key never match.
    """
    brought = [c for c in metadata.columns if c not in (*partition, key, arrival, time)]
    own = [c for c in payloads.columns if c not in (*partition, key, arrival, time)]
    puts = metadata.withColumn("match_side", F.lit(0)).withColumn("metadata_seq", F.col(arrival))
    both = puts.unionByName(payloads.withColumn("match_side", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn(time, F.col(time)).withWatermark(time, delay)
    order = [*partition, key, arrival, time, *own, "metadata_seq", *brought]
    schema = T.StructType([both.schema[c] for c in order])
    processor = ordered.OneShotMatch(key, "match_side", ["metadata_seq", *brought], limit, order, arrival, bucket_ms, time, ["match_side"])
    return ordered.run(both.select(*order, "match_side"), partition, processor, schema)


def output_fps(
    frames: DataFrame, seconds: int = 1, by: Sequence[str] = ("stream_id",), time: str = "event_time"
) -> DataFrame:
    counted = frames.groupBy(*by, F.window(time, f"{seconds} seconds").alias("w")).agg(
        F.count("*").alias("frames")
    )
    return counted.select(
        *by, F.unix_micros("w.start").alias("window_us"), "frames",
        (F.col("frames") / F.lit(float(seconds))).alias("fps"),
    )


def latest_per_tick(
    rows: DataFrame, tick: str, partition: Sequence[str] = ("stream_id", "stage"),
    arrival: str = "arrival_seq", time: str = "event_time",
) -> DataFrame:
    """Newest row per stream, stage and tick."""
    rest = [c for c in rows.columns if c not in (*partition, time)]
    newest = F.max_by(F.struct(*rest), F.struct(time, arrival)).alias("_row")
    picked = rows.groupBy(*partition, F.window(time, tick).alias("w")).agg(newest)
    return picked.select(*partition, F.unix_micros("w.start").alias("tick_us"), "_row.*")


def interval_sample(
    rows: DataFrame, interval: int, partition: Sequence[str] = ("stream_id",), value: str = "ts_us",
    arrival: str = "arrival_seq", time: str = "event_time", bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Greedy sampling in event time with the last emitted ``value`` as state."""
    processor = ordered.IntervalSampler(interval, value, rows.columns, arrival, bucket_ms, time)
    return ordered.run(rows, partition, processor, rows.schema)


def publisher_sequence(
    rows: DataFrame, partition: Sequence[str] = ("stream_id",), arrival: str = "arrival_seq",
    time: str = "event_time", bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Message number per stream, counted in event time."""
    schema = T.StructType([*rows.schema.fields, T.StructField("seq", T.LongType())])
    return ordered.run(rows, partition, ordered.Sequencer(schema.names, arrival, bucket_ms, time), schema)
