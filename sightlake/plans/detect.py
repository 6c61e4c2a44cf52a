"""Detection side: frames and detections to records and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import DEFAULT_CONFIDENCE, FRAME_KEYS, NMS_TOP_K
from ..functions.text import timing_fields
from ..operators.detections import confident, number_persons, top_k
from ..operators.keyed import join_payloads
from ..operators.messages import Publisher, target_box_arrays
from ..operators.records import HOT_OBJECTS, detect_frames, detect_objects, frame_metadata, image_records, with_time
from ..operators.suppression import suppress
from ..skew import HotKeys, find_hot_keys


def detect_records(
    frames: DataFrame,
    detections: DataFrame,
    threshold: float = DEFAULT_CONFIDENCE,
    hot: HotKeys | None = None,
    cluster: bool = False,
) -> DataFrame:
    """One record per frame: confident (optionally clustered) persons, numbered and scaled."""
    if hot is None:
        hot = find_hot_keys(detections, FRAME_KEYS, HOT_OBJECTS)
    kept = confident(detections, threshold)
    if cluster:
        kept = suppress(kept)  # counts per class, against its own limit
    return detect_frames(frames, number_persons(kept, hot=hot), hot=hot)


def detected_persons(
    frames: DataFrame, detections: DataFrame, threshold: float = DEFAULT_CONFIDENCE, hot: HotKeys | None = None
) -> DataFrame:
    """The objects of ``detect_records`` as rows; no frame is gathered."""
    return detect_objects(frames, number_persons(confident(detections, threshold), hot=hot))


def clustered_records(
    frames: DataFrame, detections: DataFrame, threshold: float = DEFAULT_CONFIDENCE, k: int = NMS_TOP_K
) -> DataFrame:
    """The detector's chain: threshold, suppression per class, best ``k`` per class, then records."""
    kept = top_k(suppress(confident(detections, threshold)), k).drop("rank")
    return detect_frames(frames, number_persons(kept))


def target_boxes(
    frames: DataFrame, detections: DataFrame, publisher: Publisher = Publisher(), **options
) -> DataFrame:
    """One target box message per frame."""
    return target_box_arrays(with_time(detect_records(frames, detections, **options)), p=publisher)


def images_with_payload(frames: DataFrame, payloads: DataFrame) -> DataFrame:
    """Image records that have a payload, matched on the buffer key of their stream."""
    return join_payloads(image_records(frames), payloads, ("stream_id", "buf_key"))


def timed_metadata(records: DataFrame, latencies: DataFrame, stage: str) -> DataFrame:
    """Metadata of detect or assess records with the stage times that were known when the record was
    made: the detector's for DETECT, both for ASSESS, none for frames without marks. ``latencies``
    has one row per frame (``stage_latency``) and meets the records on the frame key they have."""
    known = timing_fields("detect_ms", "assess_ms" if stage == "ASSESS" else None)
    times = latencies.select(*FRAME_KEYS, known.alias("_known"))
    timed = records.join(times, list(FRAME_KEYS), "left")
    return frame_metadata(timed, stage, F.coalesce("_known", F.array().cast("array<string>")))
