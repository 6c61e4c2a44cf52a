"""Log and label text, built from column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import DISPLAY_ROWS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _split(x: Column) -> tuple[Column, Column]:
    """Halves of a double whose sum is exact and whose products with small integers are too."""
    c = x * F.lit(134217729.0)
    high = c - (c - x)
    return high, x - high


def fixed(value, digits: int) -> Column:
    """Decimal text rounded half-even on the exact binary value.

    Spark's format_string rounds the shortest decimal text instead, which differs
    for values such as 2.675. Multiplying by 10^digits leaves a rounding error; it
    is recovered exactly from the split operand and decides near-ties. Exact for
    magnitudes below 2^52 / 10^digits.
    """
    x = F.abs(_col(value))
    factor = F.lit(float(10**digits))
    product = x * factor
    high, low = _split(x)
    error = (high * factor - product) + low * factor
    floor = F.floor(product)
    excess = ((product - floor) - F.lit(0.5)) + error
    units = floor + F.when(excess > 0, 1).when(excess < 0, 0).otherwise(F.pmod(floor, F.lit(2)))
    negative = (_col(value) < 0) | (_col(value).cast("string") == "-0.0")
    sign = F.when(negative, F.lit("-")).otherwise(F.lit(""))
    if digits == 0:
        return F.concat(sign, units.cast("string"))
    scale = F.lit(10**digits)
    return F.concat(
        sign,
        F.call_function("div", units, scale).cast("string"),
        F.lit("."),
        F.lpad(F.pmod(units, scale).cast("string"), digits, "0"),
    )


def bbox_text(bbox) -> Column:
    bbox = _col(bbox)
    return F.concat(F.lit("bbox="), F.concat_ws(",", *[fixed(bbox[i], 0) for i in range(4)]))


def detect_row(object_id, bbox, confidence) -> Column:
    return F.concat_ws(
        " ",
        F.concat(F.lit("object="), _col(object_id).cast("string")),
        bbox_text(bbox),
        F.concat(F.lit("person_conf="), fixed(confidence, 2)),
    )


def assess_row(object_id, bbox, lines) -> Column:
    return F.concat_ws(
        " ",
        F.concat(F.lit("object="), _col(object_id).cast("string")),
        bbox_text(bbox),
        label_log(lines),
    )


def label_lines(object_id, label_of, detector_label: str = "person") -> Column:
    """Header line plus one line per display row that has a label.

    ``label_of`` maps a head to its label (empty text when absent).
    """
    header = F.concat(F.lit(f"{detector_label} "), _col(object_id).cast("string"), F.lit(" injuries:"))

    def line(heads: Column) -> Column:
        return F.array_join(F.filter(F.transform(heads, label_of), lambda label: label != ""), "  ")

    rows = F.transform(F.array(*[F.array(*[F.lit(h) for h in row]) for row in DISPLAY_ROWS]), line)
    return F.concat(F.array(header), F.filter(rows, lambda text: text != ""))


def label_log(lines) -> Column:
    return F.array_join(_col(lines), " | ")


def timing_fields(detect_ms=None, assess_ms=None) -> Column:
    """array<string> of the stage times and rates that are known."""
    parts = []
    for name, ms in (("detect", detect_ms), ("assess", assess_ms)):
        if ms is None:
            continue
        ms = _col(ms)
        parts.append(F.when(ms.isNotNull(), F.concat(F.lit(f"{name}_ms="), fixed(ms, 2))))
        rate = F.when(ms > 0, F.lit(1000.0) / ms)
        parts.append(F.when(rate.isNotNull(), F.concat(F.lit(f"{name}_fps="), fixed(rate, 2))))
    return F.array_compact(F.array(*parts))


def frame_header(stage, frame, formatted, source, timing=None, source_size=None, image_size=None) -> Column:
    fields = [
        _col(stage),
        F.concat(F.lit("frame="), _col(frame).cast("string")),
        F.concat(F.lit("timestamp="), _col(formatted)),
        F.concat(F.lit("timestamp_source="), _col(source)),
    ]
    if timing is not None:
        text = F.array_join(_col(timing), " ")
        fields.append(F.when(text != "", text))
    for name, size in (("source", source_size), ("image", image_size)):
        if size is not None:
            w, h = _col(size[0]).cast("string"), _col(size[1]).cast("string")
            fields.append(F.concat(F.lit(f"{name}="), w, F.lit("x"), h))
    return F.array_join(F.array_compact(F.array(*fields)), " ")


def frame_log(header, rows) -> Column:
    """Header followed by the rows, each indented by two spaces."""
    indented = F.transform(_col(rows), lambda row: F.concat(F.lit("  "), row))
    return F.array_join(F.concat(F.array(_col(header)), indented), "\n")
