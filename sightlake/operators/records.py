"""Per-frame records: nested objects, metadata and log text.

A frame has one record at every size, with its objects in one array: that is the message.
Where objects alone are wanted, ``detect_objects`` and ``assess_objects`` keep them flat,
one row each, without gathering a frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import FRAME_KEYS, IMAGE_HEIGHT, IMAGE_WIDTH, PERSON_CLASS_NAME
from ..functions import text
from ..functions.clock import format_timestamp, resolve_timestamp
from ..functions.geometry import bbox, scale_bbox
from ..functions.identity import data_source_id
from ..functions.tensors import complete_predictions, labels_of
from ..skew import HotKeys, broadcast_if_small, find_hot_keys, group_row_number, no_hot_keys, sliced_row_number

# objects of an oversized frame are gathered and sorted in slices of this size
SLICE_OBJECTS = 4096
# groups become arrays here, so the limit is far below that of plain windows
HOT_OBJECTS = 20_000


def nest_objects(
    rows: DataFrame,
    fields: Sequence[Column | str],
    keys: Sequence[str] = FRAME_KEYS,
    order: str = "det_order",
    hot: HotKeys | None = None,
    slice_objects: int | None = None,
) -> DataFrame:
    """Keys, object_count and objects array<struct<object_index, ...>>, one row per frame.

    Oversized frames are sorted in slices by many tasks; only the finished slices meet."""
    keys = list(keys)
    slice_objects = slice_objects or SLICE_OBJECTS
    if hot is None:
        hot = find_hot_keys(rows, keys, HOT_OBJECTS)

    def in_order() -> Column:
        # sorts (order, position) pairs, as bodies with maps cannot be compared
        places = F.transform("_items", lambda item, i: F.struct(item["_o"].alias("o"), i.alias("i")))
        return F.transform(F.array_sort(places), lambda place: F.get("_items", place["i"]))

    item = F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("body"))

    def whole(r: DataFrame) -> DataFrame:
        return r.groupBy(*keys).agg(F.collect_list(item).alias("_items")).select(*keys, in_order().alias("_items"))

    def sliced(r: DataFrame) -> DataFrame:
        numbered = sliced_row_number(r, keys, [F.col(order)], "_rn")
        number = F.floor((F.col("_rn") - 1) / slice_objects).cast("bigint").alias("_slice")
        slices = numbered.groupBy(*keys, number).agg(F.collect_list(item).alias("_items"))
        slices = slices.select(*keys, F.struct("_slice", in_order().alias("items")).alias("_slice"))
        by_number = lambda x, y: F.when(x["_slice"] < y["_slice"], -1).otherwise(1)
        joined = F.array_sort(F.collect_list("_slice"), by_number)
        return slices.groupBy(*keys).agg(joined.alias("_slices")).select(*keys, F.flatten("_slices.items").alias("_items"))

    nested = whole(rows) if not hot.present else (
        whole(hot.exclude(rows)).unionByName(sliced(hot.only(rows)))
    )
    body = [f.name for f in nested.schema["_items"].dataType.elementType["body"].dataType.fields]
    flat = F.transform("_items", lambda o, i: F.struct(
        i.cast("int").alias("object_index"), *[o["body"][n].alias(n) for n in body]
    ))
    return nested.select(*keys, F.size("_items").cast("bigint").alias("object_count"), flat.alias("objects"))


def attach_objects(
    frames: DataFrame, nested: DataFrame, keys: Sequence[str] = FRAME_KEYS,
    hot: HotKeys | None = None, keep_empty: bool = True,
) -> DataFrame:
    """Frames with their objects. With ``keep_empty`` a frame without objects keeps an empty array."""
    keys = list(keys)
    hot = hot or no_hot_keys(keys)
    how = "left" if keep_empty else "inner"
    if hot.present:
        regular = hot.exclude(frames).join(hot.exclude(nested), keys, how)
        few = broadcast_if_small(hot.only(frames))
        joined = regular.unionByName(hot.only(nested).join(few, keys), allowMissingColumns=True)
    else:
        joined = frames.join(nested, keys, how)
    empty = F.array().cast(nested.schema["objects"].dataType)
    return joined.select(
        *frames.columns,
        F.coalesce("object_count", F.lit(0).cast("bigint")).alias("object_count"),
        F.coalesce("objects", empty).alias("objects"),
    )


def with_time(frames: DataFrame, image=(IMAGE_WIDTH, IMAGE_HEIGHT)) -> DataFrame:
    """Frames with resolved source time, its text, the wire id and the image size."""
    out = frames.withColumn("_ts", resolve_timestamp()).withColumns({
        "timestamp_source": F.col("_ts.source"), "timestamp_ns": F.col("_ts.ts_ns"),
    }).drop("_ts")
    if "img_w" not in out.columns:
        out = out.withColumns({"img_w": F.lit(image[0]), "img_h": F.lit(image[1])})
    return out.withColumns({
        "timestamp": format_timestamp("timestamp_source", "timestamp_ns"),
        "data_source_id": data_source_id(F.lit(None).cast("string"), "frame"),
    })


def image_records(frames: DataFrame) -> DataFrame:
    """Raw image records: identity, time and sizes, no objects."""
    return with_time(frames).select(
        "stream_id", F.lit("IMAGE").alias("stage"), "frame", "timestamp_ns", "timestamp", "timestamp_source",
        "data_source_id", F.lit(0).cast("bigint").alias("object_count"),
        F.col("src_w").alias("source_width"), F.col("src_h").alias("source_height"),
        F.col("img_w").alias("image_width"), F.col("img_h").alias("image_height"),
        F.lit("image").alias("bbox_coordinate_space"), "buf_key", "arrival_seq",
    )


def _scaled(extra) -> Column:
    """objects with image-space bbox next to the source one; sizes come from the frame."""
    return F.transform("objects", lambda o: F.struct(
        o["object_index"].alias("object_index"),
        o["object_id"].alias("object_id"),
        scale_bbox(o["source_bbox"]).alias("bbox"),
        o["source_bbox"].alias("source_bbox"),
        F.lit(PERSON_CLASS_NAME).alias("class_name"),
        *extra(o),
    ))


def detect_frames(
    frames: DataFrame, numbered: DataFrame, hot: HotKeys | None = None, slice_objects: int | None = None
) -> DataFrame:
    """One record per frame with its numbered persons; empty frames stay."""
    if hot is None:
        hot = find_hot_keys(numbered, FRAME_KEYS, HOT_OBJECTS)
    fields = [F.col("object_id"), bbox().alias("source_bbox"), F.col("confidence")]
    nested = nest_objects(numbered, fields, hot=hot, slice_objects=slice_objects)
    whole = attach_objects(frames, nested, hot=hot)
    return whole.withColumn("objects", _scaled(lambda o: [o["confidence"].alias("confidence")]))


def assess_frames(
    frames: DataFrame, assessed: DataFrame, hot: HotKeys | None = None, slice_objects: int | None = None
) -> DataFrame:
    """One record per frame with at least one assessed object.

    ``assessed`` has the object's id, box and prediction map.
    """
    if hot is None:
        hot = find_hot_keys(assessed, FRAME_KEYS, HOT_OBJECTS)
    fields = [
        F.col("object_id"), bbox().alias("source_bbox"),
        text.label_lines("object_id", labels_of("predictions")).alias("labels"),
        complete_predictions("predictions").alias("predictions"),
    ]
    order = "det_order" if "det_order" in assessed.columns else "object_id"
    nested = nest_objects(assessed, fields, order=order, hot=hot, slice_objects=slice_objects)
    whole = attach_objects(frames, nested, hot=hot, keep_empty=False)
    return whole.withColumn(
        "objects", _scaled(lambda o: [o["labels"].alias("labels"), o["predictions"].alias("predictions")])
    )


def assessed_objects(numbered: DataFrame, predicted: DataFrame) -> DataFrame:
    """Numbered persons with their prediction map; persons without predictions drop out."""
    return numbered.join(predicted, [*FRAME_KEYS, "object_id"])


def _flat(frames: DataFrame, objects: DataFrame, index: Column, *extra: Column) -> DataFrame:
    """Objects joined with their frame's sizes; a frame with very many is a skewed join key only."""
    sizes = ("src_w", "src_h", "img_w", "img_h")
    sized = objects.join(frames.select(*FRAME_KEYS, *[c for c in sizes if c in frames.columns]), list(FRAME_KEYS))
    return sized.select(
        *FRAME_KEYS, index.alias("object_index"), "object_id", scale_bbox(bbox()).alias("bbox"),
        bbox().alias("source_bbox"), F.lit(PERSON_CLASS_NAME).alias("class_name"), *extra,
    )


def detect_objects(frames: DataFrame, numbered: DataFrame) -> DataFrame:
    """One row per numbered person, as in the frame's record."""
    return _flat(frames, numbered, F.col("ordinal"), F.col("confidence"))


def assess_objects(frames: DataFrame, assessed: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """One row per assessed person, as in the frame's record."""
    order = "det_order" if "det_order" in assessed.columns else "object_id"
    placed = group_row_number(assessed, FRAME_KEYS, [F.col(order)], "_rn", hot)
    return _flat(
        frames, placed, (F.col("_rn") - 1).cast("int"),
        text.label_lines("object_id", labels_of("predictions")).alias("labels"),
        complete_predictions("predictions").alias("predictions"),
    )


def _log_rows(stage: str) -> Column:
    if stage == "DETECT":
        return F.transform("objects", lambda o: text.detect_row(o["object_id"], o["bbox"], o["confidence"]))
    return F.transform("objects", lambda o: text.assess_row(o["object_id"], o["bbox"], o["labels"]))


def frame_metadata(records: DataFrame, stage: str, timing: Column | None = None) -> DataFrame:
    """The full metadata record of detect or assess frames, ready for ``to_json``."""
    timing = F.array().cast("array<string>") if timing is None else timing
    timed = with_time(records).withColumn("timing", timing).withColumn("rows", _log_rows(stage))
    header = text.frame_header(
        F.lit(stage), "frame", "timestamp", "timestamp_source", "timing", ("src_w", "src_h"), ("img_w", "img_h")
    )
    return timed.select(
        "stream_id", F.lit(stage).alias("stage"), "frame", "timestamp_ns", "timestamp",
        "timestamp_source",
        F.col("timestamp_ns").alias("source_timestamp_ns"), F.col("timestamp").alias("source_timestamp"),
        F.col("timestamp_source").alias("source_timestamp_source"), F.lit(True).alias("timestamp_is_source"),
        "timing", "rows", "objects", "object_count", "data_source_id", text.frame_log(header, "rows").alias("log_text"),
        F.col("src_w").alias("source_width"), F.col("src_h").alias("source_height"),
        F.col("img_w").alias("image_width"), F.col("img_h").alias("image_height"),
        F.lit("image").alias("bbox_coordinate_space"), "buf_key", "arrival_seq",
    )
