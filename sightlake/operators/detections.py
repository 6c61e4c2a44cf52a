"""Detection filters, per-frame numbering and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..constants import (
    DEFAULT_CONFIDENCE, DETECTOR_ID, FRAME_KEYS, MIN_ASSESS_SIDE, NMS_TOP_K, PERSON_CLASS_ID,
)
from ..skew import HotKeys, group_row_number


def persons(detections: DataFrame) -> DataFrame:
    return detections.filter(F.col("class_id") == PERSON_CLASS_ID)


def confident(detections: DataFrame, threshold: float = DEFAULT_CONFIDENCE) -> DataFrame:
    return detections.filter(F.col("confidence") >= threshold)


def assessable(
    detections: DataFrame, min_side: float = MIN_ASSESS_SIDE, detector_id: int = DETECTOR_ID
) -> DataFrame:
    """Detections the second model looks at: persons of the given detector, large enough."""
    big = (F.col("width") >= min_side) & (F.col("height") >= min_side)
    if "detector_id" in detections.columns:
        big = big & (F.col("detector_id") == detector_id)
    return persons(detections).filter(big)


def number_persons(
    detections: DataFrame,
    keys: Sequence[str] = FRAME_KEYS,
    order: str = "det_order",
    stored_id: str | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Persons with ``ordinal`` (0-based, detection order) and ``object_id``.

    A stored id of at least 1 means ordinal stored_id - 1; 0 or NULL means unset,
    and the ordinal is used.
    """
    numbered = group_row_number(persons(detections), keys, [F.col(order)], "_rn", hot)
    numbered = numbered.withColumn("ordinal", (F.col("_rn") - 1).cast("int")).drop("_rn")
    object_id = F.col("ordinal")
    if stored_id is not None:
        stored = F.col(stored_id)
        object_id = F.coalesce(F.when(stored >= 1, stored - 1).cast("int"), object_id)
    return numbered.withColumn("object_id", object_id)


def top_k(
    detections: DataFrame,
    k: int = NMS_TOP_K,
    keys: Sequence[str] = (*FRAME_KEYS, "class_id"),
    order: str = "det_order",
) -> DataFrame:
    """Best ``k`` per frame and class. Spark keeps only k rows per group before the shuffle."""
    best = W.partitionBy(*keys).orderBy(F.col("confidence").desc(), F.col(order))
    return detections.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
