"""Assessment side: tensors to per-person records and messages, and the three-way fork."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import BRANCHES, DEFAULT_CONFIDENCE, FRAME_KEYS
from ..operators.detections import assessable, confident, number_persons
from ..operators.messages import Publisher, casualty_messages, image_messages, recording, target_box_arrays
from ..operators.predictions import predict_objects
from ..operators.records import (
    HOT_OBJECTS, assess_frames, assess_objects, assessed_objects, frame_metadata, image_records, with_time,
)
from ..skew import HotKeys, find_hot_keys
from .detect import detect_records


def assess_records(
    frames: DataFrame,
    detections: DataFrame,
    tensors: DataFrame,
    threshold: float = DEFAULT_CONFIDENCE,
    hot: HotKeys | None = None,
) -> DataFrame:
    """One record per frame with its assessed persons.

    Persons get their number before the size filter, so ids agree with the detect records.
    """
    if hot is None:
        hot = find_hot_keys(detections, FRAME_KEYS, HOT_OBJECTS)
    numbered = assessable(number_persons(confident(detections, threshold), hot=hot))
    return assess_frames(frames, assessed_objects(numbered, predict_objects(tensors)), hot=hot)


def assessed_persons(
    frames: DataFrame,
    detections: DataFrame,
    tensors: DataFrame,
    threshold: float = DEFAULT_CONFIDENCE,
    hot: HotKeys | None = None,
) -> DataFrame:
    """The objects of ``assess_records`` as rows; no frame is gathered."""
    if hot is None:
        hot = find_hot_keys(detections, FRAME_KEYS, HOT_OBJECTS)
    numbered = assessable(number_persons(confident(detections, threshold), hot=hot))
    return assess_objects(frames, assessed_objects(numbered, predict_objects(tensors)), hot)


def casualties(
    frames: DataFrame, detections: DataFrame, tensors: DataFrame, publisher: Publisher = Publisher(), **options
) -> DataFrame:
    """One casualty message per assessed person."""
    people = assessed_persons(frames, detections, tensors, **options)
    timed = with_time(frames).select(*FRAME_KEYS, "timestamp_ns", "data_source_id")
    return casualty_messages(people.join(timed, list(FRAME_KEYS)), p=publisher)


def fork(
    frames: DataFrame, detections: DataFrame, tensors: DataFrame, hot: HotKeys | None = None
) -> dict[str, DataFrame]:
    """The three metadata branches of one set of frames."""
    if hot is None and not detections.isStreaming:
        hot = find_hot_keys(detections, FRAME_KEYS, HOT_OBJECTS)
    return dict(zip(BRANCHES, (
        image_records(frames),
        frame_metadata(detect_records(frames, detections, hot=hot), "DETECT"),
        frame_metadata(assess_records(frames, detections, tensors, hot=hot), "ASSESS"),
    )))


def record_topics(
    frames: DataFrame, detections: DataFrame, tensors: DataFrame, publisher: Publisher = Publisher(),
    hot: HotKeys | None = None,
) -> DataFrame:
    """Messages of all three topics in one table, without payload bytes."""
    images = image_messages(image_records(frames), p=publisher).select(
        *FRAME_KEYS, "stamp", "frame_id", "format"
    )
    boxes = target_box_arrays(with_time(detect_records(frames, detections, hot=hot)), p=publisher)
    people = casualties(frames, detections, tensors, publisher, hot=hot)
    return recording({"image": images, "target_detections": boxes, "casualty": people})
