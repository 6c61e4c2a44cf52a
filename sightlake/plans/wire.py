"""Sender and publisher: records and payloads to packets, packets to messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..constants import DEFAULT_FORMAT, TOPICS
from ..operators.keyed import join_payloads, latest_metadata
from ..operators.messages import (
    Publisher, casualty_messages, image_messages, publisher_sequence, route, target_box_arrays,
)
from ..operators.sampling import interval_sample
from ..session import materialize
from ..sources.packets import parse_metadata

MISSING = "metadata=missing"


def build_packets(
    records: DataFrame, payloads: DataFrame, stage: str, keys: Sequence[str] = ("stream_id", "buf_key"),
    arrival: str = "arrival_seq", require_metadata: bool = False, image_format: str = DEFAULT_FORMAT,
) -> DataFrame:
    """One packet per payload: its columns and ``metadata`` (JSON with format and bytes).

    A payload takes the record put under its buffer key, else the newest record of its stream,
    else a stub that says so. With ``require_metadata`` only the first kind is sent. ``payloads``
    have n_bytes.
    """
    partition = list(keys[:-1])
    # the sender's format and bytes replace any of the record's own
    body = [c for c in records.columns if c not in (*keys, arrival, "format", "bytes")]
    if not body:
        raise ValueError("records need at least one column besides keys and arrival")
    puts = records.select(*keys, arrival, F.to_json(F.struct(*body)).alias("_record"))
    matched = join_payloads(puts, payloads, keys, arrival, require_metadata).drop("metadata_seq")
    text = F.col("_record")
    if not require_metadata:
        matched = latest_metadata(matched, puts, "_record", partition, arrival)
        stub = F.to_json(F.struct(F.lit(stage).alias("stage"), F.lit(f"{stage} {MISSING}").alias("log_text")))
        text = F.coalesce("_record", "latest__record", stub)
    wire = F.to_json(F.struct(F.lit(image_format).alias("format"), F.col("n_bytes").alias("bytes")))
    whole = F.concat(F.expr("left(_text, length(_text) - 1)"), F.lit(","), F.substring(wire, 2, 1_000))
    return matched.withColumn("_text", text).select(*payloads.columns, whole.alias("metadata"))


def publish_packets(
    packets: DataFrame, publisher: Publisher = Publisher(), ingest: str | None = None, arrival: str = "arrival_seq",
    partition: Sequence[str] = ("stream_id",),
) -> DataFrame:
    """Image messages of the image packets (metadata, payload): stamped once, numbered, with bytes."""
    taken = materialize(received(packets, "image", ingest), "received")  # numbering reads it twice
    numbered = publisher_sequence(taken, [*partition, "topic"], arrival)
    return image_messages(numbered, "message_ts_ns", F.col("payload"), publisher)


def received(packets: DataFrame, topic: str, ingest: str | None = None) -> DataFrame:
    """Parsed packets of one topic. ``ingest`` (nanoseconds) stamps those without a time of their own."""
    return route(parse_metadata(packets, ingest)).filter(F.col("topic") == topic)


def publish_targets(
    packets: DataFrame, publisher: Publisher = Publisher(), ingest: str | None = None, arrival: str = "arrival_seq",
    partition: Sequence[str] = ("stream_id",),
) -> DataFrame:
    """One box array per detect packet, also without boxes: own number, stamp shared with its image."""
    taken = materialize(received(packets, "target_detections", ingest), "received")
    numbered = publisher_sequence(taken, partition, arrival)
    return target_box_arrays(numbered, "message_ts_ns", F.col("payload"), publisher)


def publish_casualties(packets: DataFrame, publisher: Publisher = Publisher(), ingest: str | None = None) -> DataFrame:
    """One casualty message per object of an assess packet; each carries the packet's image and stamp."""
    return casualty_messages(received(packets, "casualty", ingest), "message_ts_ns", F.col("payload"), publisher)


def publish_log(
    packets: DataFrame, interval: int, time: str, arrival: str = "arrival_seq", partition: Sequence[str] = ("stream_id",),
) -> DataFrame:
    """What publishers log: topic, messages, bytes and the packet's own text, at most every ``interval``.

    ``time`` is when a packet came in, in the unit of ``interval``. Only narrow rows are sampled:
    payloads and objects give their sizes before any shuffle. They are written once, as sampling reads its rows
    several times."""
    per_object = F.col("topic") == TOPICS["ASSESS"]
    sent = route(parse_metadata(packets)).select(
        *partition, arrival, time, "topic", "log_text",
        F.when(per_object, F.size("objects")).otherwise(1).cast("bigint").alias("messages"),
        F.coalesce(F.octet_length("payload"), F.lit(0)).cast("bigint").alias("n_bytes"),
    )
    logged = interval_sample(materialize(sent, "sent"), interval, [*partition, "topic"], time, arrival)
    counts = F.format_string("published topic=%s messages=%d bytes=%d", "topic", "messages", "n_bytes")
    return logged.withColumn("text", F.concat(counts, F.lit("\n"), "log_text"))
