"""Box scaling, overlay geometry, colours and model input sizes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import (
    DEFAULT_FRAME_HEIGHT, FONT_SCALE, LINE_WIDTH, MIN_TEXT_HEIGHT, MODEL_STRIDE, RAMP_MIN_SPAN,
    RAMP_TOP, TEXT_GAP,
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bbox(left="left", top="top", width="width", height="height") -> Column:
    return F.array(*[_col(c).cast("double") for c in (left, top, width, height)])


def positive(size, name: str) -> Column:
    """The size itself; the query fails where it is missing, zero or negative."""
    size = _col(size)
    return F.when(size > 0, size).otherwise(F.raise_error(F.lit(f"{name} must be positive")).cast("int"))


def scale_bbox(box, src_w="src_w", src_h="src_h", img_w="img_w", img_h="img_h") -> Column:
    """Box moved from source to image coordinates; the ratio is formed before multiplying."""
    box = _col(box)
    x = positive(img_w, "image_width").cast("double") / positive(src_w, "source_width")
    y = positive(img_h, "image_height").cast("double") / positive(src_h, "source_height")
    return F.array(box[0] * x, box[1] * y, box[2] * x, box[3] * y)


def center_size(box) -> Column:
    """struct<center_x, center_y, size_x, size_y>; a missing box becomes zeros."""
    box = F.coalesce(_col(box), F.array(*[F.lit(0.0)] * 4))
    return F.struct(
        (box[0] + box[2] / 2).alias("center_x"),
        (box[1] + box[3] / 2).alias("center_y"),
        box[2].alias("size_x"),
        box[3].alias("size_y"),
    )


def confidence_color(confidence, low: float) -> Column:
    """struct<r,g,b,a>: red at ``low`` through yellow to green at the ramp's top."""
    c = _col(confidence)
    mid = (low + RAMP_TOP) / 2.0
    rising = (c - F.lit(low)) / F.lit(max(mid - low, RAMP_MIN_SPAN))
    falling = F.lit(1.0) - (c - F.lit(mid)) / F.lit(max(RAMP_TOP - mid, RAMP_MIN_SPAN))
    one, zero = F.lit(1.0), F.lit(0.0)
    red = F.when(c < mid, one).when(c < RAMP_TOP, falling).otherwise(zero)
    green = F.when(c <= low, zero).when(c < mid, rising).otherwise(one)
    # at or below the lower end the box is red even when the ramp has no width
    red = F.when(c <= low, one).otherwise(red)
    return F.struct(red.alias("r"), green.alias("g"), zero.alias("b"), one.alias("a"))


def _corners(box: Column) -> tuple[Column, ...]:
    x1, y1 = F.rint(box[0]), F.rint(box[1])
    x2, y2 = F.rint(box[0] + box[2]), F.rint(box[1] + box[3])
    return tuple(v.cast("bigint") for v in (x1, y1, x2, y2))


def overlay_segments(box) -> Column:
    """The four sides of a box, clockwise from the top, as array<struct<x1,y1,x2,y2>>."""
    x1, y1, x2, y2 = _corners(_col(box))
    corners = ((x1, y1), (x2, y1), (x2, y2), (x1, y2))
    sides = []
    for here, there in zip(corners, corners[1:] + corners[:1]):
        sides.append(F.struct(
            here[0].alias("x1"), here[1].alias("y1"), there[0].alias("x2"), there[1].alias("y2")
        ))
    return F.array(*sides)


def overlay_label(box, frame_height) -> Column:
    """struct<x_offset, y_offset, font_size> of the label above a box."""
    x1, y1, _, _ = _corners(_col(box))
    height = F.when(_col(frame_height) != 0, _col(frame_height)).otherwise(F.lit(DEFAULT_FRAME_HEIGHT))
    font = F.greatest(F.lit(1), F.rint(height * F.lit(FONT_SCALE)).cast("bigint"))
    text_height = F.greatest(F.lit(MIN_TEXT_HEIGHT), font * 2 + TEXT_GAP)
    zero = F.lit(0).cast("bigint")
    return F.named_struct(
        F.lit("x_offset"), F.greatest(zero, x1 - LINE_WIDTH // 2),
        F.lit("y_offset"), F.greatest(zero, y1 - text_height),
        F.lit("font_size"), font,
    )


def assessment_text_offset(box) -> Column:
    """struct<x_offset, y_offset> of the label block below a box."""
    box = _col(box)
    zero = F.lit(0).cast("bigint")
    return F.named_struct(
        F.lit("x_offset"), F.greatest(zero, F.rint(box[0]).cast("bigint")),
        F.lit("y_offset"), F.greatest(zero, F.rint(box[1] + box[3] + TEXT_GAP).cast("bigint")),
    )


def model_input_size(width, height, long_side, stride: int = MODEL_STRIDE) -> Column:
    """struct<width, height>: long side and proportional short side, rounded up to the stride."""
    w, h, side = (_col(c).cast("bigint") for c in (width, height, long_side))

    def up(x: Column) -> Column:
        steps = F.call_function("div", x + (stride - 1), F.lit(stride).cast("bigint"))
        return F.greatest(F.lit(stride).cast("bigint"), steps * stride)

    def short(other: Column, longest: Column) -> Column:
        return up(F.floor((side * other).cast("double") / longest).cast("bigint"))

    wide = w >= h
    return F.struct(
        F.when(wide, up(side)).otherwise(short(w, h)).alias("width"),
        F.when(wide, short(h, w)).otherwise(up(side)).alias("height"),
    )
