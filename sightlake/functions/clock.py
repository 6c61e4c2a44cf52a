"""Source-time expressions. Times are bigint nanoseconds; NULL means unknown."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import NS_PER_SECOND, NTP_TO_UNIX_SECONDS
from .text import fixed

_NTP_OFFSET_NS = NTP_TO_UNIX_SECONDS * NS_PER_SECOND


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def valid_clock(ts, *, zero_ok: bool) -> Column:
    """The clock value, or NULL where it is negative or a disallowed zero."""
    ts = _col(ts)
    return F.when(ts >= 0 if zero_ok else ts > 0, ts)


def ntp_to_unix(ts) -> Column:
    ts = _col(ts)
    return F.when(ts > F.lit(_NTP_OFFSET_NS), ts - F.lit(_NTP_OFFSET_NS)).otherwise(ts)


def resolve_timestamp(ntp="ntp_raw", ref="ref_raw", buf_pts="buf_pts", pts="pts") -> Column:
    """First usable clock as struct<source, ts_ns>: ntp, ref, buf_pts, pts, else none."""
    candidates = (
        ("ntp", ntp_to_unix(valid_clock(ntp, zero_ok=False))),
        ("ref", ntp_to_unix(valid_clock(ref, zero_ok=False))),
        ("buf_pts", valid_clock(buf_pts, zero_ok=True)),
        ("pts", valid_clock(pts, zero_ok=True)),
    )
    source = F.lit("none")
    for name, value in reversed(candidates):
        source = F.when(value.isNotNull(), F.lit(name)).otherwise(source)
    return F.struct(source.alias("source"), F.coalesce(*[v for _, v in candidates]).alias("ts_ns"))


def format_timestamp(source, ts) -> Column:
    """Wall-clock text for ntp/ref, seconds text for stream clocks, NONE when unknown.

    The wall clock is rounded to microseconds through a double and then cut to
    milliseconds, as producers do; a bigint of nanoseconds always fits a date.
    """
    source, ts = _col(source), _col(ts)
    seconds = ts.cast("double") / F.lit(float(NS_PER_SECOND))
    whole = F.floor(seconds)
    micros = F.rint((seconds - whole) * F.lit(1e6)).cast("bigint")
    wall = F.concat(
        F.date_format(F.timestamp_micros(whole * F.lit(1_000_000) + micros), "HH:mm:ss.SSS"), F.lit("Z")
    )
    return (
        F.when(ts.isNull(), F.lit("NONE"))
        .when(source.isin("ntp", "ref"), wall)
        .otherwise(F.concat(fixed(seconds, 3), F.lit("s")))
    )


def stamp(ts) -> Column:
    """struct<sec, nanosec> with floor semantics, so nanosec is never negative."""
    ts = _col(ts)
    nanosec = F.pmod(ts, F.lit(NS_PER_SECOND))
    # exact: the difference is a multiple of a second
    sec = F.call_function("div", ts - nanosec, F.lit(NS_PER_SECOND))
    return F.struct(sec.cast("bigint").alias("sec"), nanosec.cast("int").alias("nanosec"))


def integer_text(value) -> Column:
    """bigint from integer text (white space around, sign, single underscores between digits) else NULL."""
    text = F.regexp_replace(_col(value), r"(?U)^\s+|\s+$", "")
    return F.when(
        text.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.regexp_replace(text, "_", "").try_cast("bigint")
    )


def variant_kind(json, key: str) -> Column:
    """Type name of a JSON variant's key; NULL without the key, VOID for null."""
    return F.schema_of_variant(F.try_variant_get(_col(json), f"$.{key}", "variant"))


def integer_value(json, key: str, kind=None, fractions: bool = True) -> Column:
    """bigint from a key of a JSON variant, by the value's own type: true is 1, text must be an
    integer, numbers written with a fraction or exponent are cut (NULL without ``fractions``).
    NULL for anything else. ``kind`` is a column that has ``variant_kind`` already."""
    json, path = _col(json), f"$.{key}"
    kind = variant_kind(json, key) if kind is None else _col(kind)
    number = F.try_variant_get(json, path, "double").try_cast("bigint")
    whole = (
        F.when(kind == "BIGINT", F.try_variant_get(json, path, "bigint"))
        .when(kind == "STRING", integer_text(F.try_variant_get(json, path, "string")))
        .when(kind == "BOOLEAN", F.try_variant_get(json, path, "boolean").cast("bigint"))
    )
    return whole.when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), number) if fractions else whole


def message_timestamp(source_ts, ts, ingest=None) -> Column:
    """Stamp of a message: source time, then packet time, then the ingestion column if given.

    Times are text, or columns that are integers already."""
    choices = [_col(c) if not isinstance(c, str) else integer_text(c) for c in (source_ts, ts)]
    if ingest is not None:
        choices.append(_col(ingest))
    return F.coalesce(*choices)


def event_time(ts_ns) -> Column:
    """Spark timestamp (microseconds) for watermarks; keep the bigint for exact values."""
    return F.timestamp_micros(F.floor(_col(ts_ns) / 1000).cast("bigint"))


def rate_from_ms(ms) -> Column:
    ms = _col(ms)
    return F.when(ms > 0, F.lit(1000.0) / ms)


def rate_from_seconds(seconds) -> Column:
    s = _col(seconds)
    return F.when(s > 0, F.lit(1.0) / s).otherwise(F.lit(0.0))
