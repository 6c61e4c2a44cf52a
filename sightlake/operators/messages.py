"""Output messages built from frame records. No shuffle: arrays are transformed in place."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import DEFAULT_FORMAT, DETECTION_SOURCE, PERSON_CLASS_NAME, TOPICS
from ..functions.clock import stamp
from ..functions.geometry import center_size
from ..functions.tensors import annotations
from ..skew import BUCKET_ROWS, bucketed_row_number


@dataclass(frozen=True)
class Publisher:
    frame_id: str = "camera"
    system_id: int = 0
    platform_name: str = "platform"
    sensor_frame_id: str = "camera"


def _image(p: Publisher, data: Column | None) -> Column:
    payload = F.lit(None).cast("binary") if data is None else data
    return F.struct(
        F.col("stamp"), F.lit(p.frame_id).alias("frame_id"),
        F.coalesce(F.col("format"), F.lit(DEFAULT_FORMAT)).alias("format"), payload.alias("data"),
    )


def _stamped(records: DataFrame, ts: str) -> DataFrame:
    out = records.withColumn("stamp", stamp(ts))
    return out if "format" in out.columns else out.withColumn("format", F.lit(None).cast("string"))


def image_messages(
    records: DataFrame, ts: str = "timestamp_ns", data: Column | None = None, p: Publisher = Publisher()
) -> DataFrame:
    """One compressed image per record."""
    kept = [c for c in records.columns if c not in ("stamp", "frame_id", "format", "data")]
    return _stamped(records, ts).withColumn("message", _image(p, data)).select(*kept, "message.*")


def publisher_sequence(
    messages: DataFrame, partition: Sequence[str] = ("stream_id",), arrival: str = "arrival_seq",
    width: int = BUCKET_ROWS,
) -> DataFrame:
    """Message number ``seq`` per stream, from 0, in arrival order."""
    numbered = bucketed_row_number(messages, partition, arrival, "_rn", width)
    return numbered.withColumn("seq", F.col("_rn") - 1).drop("_rn")


def target_box_arrays(
    records: DataFrame, ts: str = "timestamp_ns", data: Column | None = None, p: Publisher = Publisher()
) -> DataFrame:
    """One message per detect record with a box per object; an empty array is allowed."""
    def box(o: Column) -> Column:
        shape = center_size(o["bbox"])
        return F.struct(
            F.col("data_source_id"),
            shape["center_x"].alias("center_x"), shape["center_y"].alias("center_y"),
            shape["size_x"].alias("size_x"), shape["size_y"].alias("size_y"),
            F.lit(True).alias("use_for_assessment"), F.lit(DETECTION_SOURCE).alias("detection_source"),
            F.coalesce(o["class_name"], F.lit(PERSON_CLASS_NAME)).alias("detection_class"),
            F.coalesce(o["confidence"], F.lit(0.0)).alias("detection_confidence"),
        )

    kept = [c for c in ("stream_id", "frame", "seq", "arrival_seq") if c in records.columns]
    return _stamped(records, ts).select(
        *kept, "stamp", F.lit(p.frame_id).alias("frame_id"), F.lit(p.system_id).alias("system_id"),
        _image(p, data).alias("source_img"), F.lit(1.0).alias("gimbal_w"),
        F.lit(False).alias("use_for_mosaic"), F.lit(DETECTION_SOURCE).alias("detection_source"),
        F.transform("objects", box).alias("uav_target_boxes"),
    )


def casualty_messages(
    records: DataFrame, ts: str = "timestamp_ns", data: Column | None = None, p: Publisher = Publisher()
) -> DataFrame:
    """One message per assessed object; all of a frame share stamp and data_source_id.

    ``records`` are nested frame records, or flat objects with their frame's columns."""
    kept = [c for c in ("stream_id", "frame", "arrival_seq") if c in records.columns]
    each = _stamped(records, ts)
    if "objects" in records.columns:
        each = each.withColumn("o", F.explode("objects")).drop("objects")
    else:
        each = each.withColumn("o", F.struct("object_id", "bbox", "predictions"))
    zeros = F.array(*[F.lit(0.0)] * 4)
    box = F.coalesce(F.col("o.bbox"), zeros)
    return each.select(
        *kept, F.col("o.object_id").alias("object_id"), "data_source_id", "stamp", _image(p, data).alias("image"),
        F.col("stamp").alias("position_stamp"), F.lit(p.frame_id).alias("position_frame_id"),
        annotations("o.predictions").alias("annotations"),
        *[box[i].alias(f"bbox_{n}") for i, n in enumerate(("x", "y", "width", "height"))],
        F.lit(p.sensor_frame_id).alias("sensor_frame_id"), F.lit(p.platform_name).alias("platform_name"),
        F.lit(False).alias("is_sensor_frame_moving"),
    )


def route(packets: DataFrame, topics: Mapping[str, str] = TOPICS) -> DataFrame:
    """Packets with the ``topic`` of their stage; packets of other stages have none and drop out."""
    pairs = [x for stage, topic in topics.items() for x in (F.lit(stage), F.lit(topic))]
    topic = F.try_element_at(F.create_map(*pairs), F.col("stage"))
    return packets.withColumn("topic", topic).filter(F.col("topic").isNotNull())


def recording(messages: Mapping[str, DataFrame]) -> DataFrame:
    """All topics as one table (topic, stream_id, frame, stamp, message JSON)."""
    out = None
    for topic, df in messages.items():
        rest = [c for c in df.columns if c not in ("stream_id", "frame", "stamp")]
        one = df.select(
            F.lit(topic).alias("topic"), "stream_id", "frame", "stamp",
            F.to_json(F.struct(*rest)).alias("message"),
        )
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def write_recording(recorded: DataFrame, path: str) -> None:
    recorded.write.mode("append").partitionBy("topic").parquet(path)


def publish_audit(published: DataFrame, by: Sequence[str] = ("topic",)) -> DataFrame:
    """Packets, messages and payload bytes per topic."""
    return published.groupBy(*by).agg(
        F.count("*").alias("packets"), F.sum("messages").alias("messages"), F.sum("n_bytes").alias("bytes")
    )
