"""Ids and keys of frames and buffers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import INT32_MAX
from .clock import _col, integer_text, valid_clock


def data_source_id(explicit, frame) -> Column:
    """Explicit id when present (0 if it is not an integer), else the frame number wrapped."""
    explicit = _col(explicit)
    wrapped = F.pmod(F.coalesce(_col(frame).cast("bigint"), F.lit(0)), F.lit(INT32_MAX))
    return F.when(
        explicit.isNotNull(), F.coalesce(integer_text(explicit.cast("string")), F.lit(0).cast("bigint"))
    ).otherwise(wrapped)


def packet_source_id(explicit, kind, frame) -> Column:
    """The id of a packet: an explicit value (0 if it is no integer), else the frame. ``kind`` is the
    JSON type of the explicit value, NULL or VOID if there is none."""
    given = F.coalesce(_col(kind) != "VOID", F.lit(False))
    return F.when(given, F.coalesce(_col(explicit), F.lit(0))).otherwise(data_source_id(F.lit(None).cast("string"), frame))


def buffer_key(pts, dts) -> Column:
    """Join key of a compressed buffer; NULL when neither clock is usable."""
    return F.coalesce(valid_clock(pts, zero_ok=True), valid_clock(dts, zero_ok=True))
