"""Greedy per-class non-maximum suppression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..constants import FRAME_KEYS, NMS_IOU
from ..session import materialize
from ..skew import HotKeys, find_hot_keys, sliced_row_number, split_hot

# best boxes of a grid cell that are looked at in one round
CELL_BOXES = 256
# groups are handled as arrays, so the limit is lower than for plain windows
HOT_BOXES = 2_000


def overlap_exceeds(a: Column, b: Column, iou: float) -> Column:
    """True where the two boxes' intersection over union is above ``iou``."""
    x = F.least(a["left"] + a["width"], b["left"] + b["width"]) - F.greatest(a["left"], b["left"])
    y = F.least(a["top"] + a["height"], b["top"] + b["height"]) - F.greatest(a["top"], b["top"])
    inter = x * y
    union = a["width"] * a["height"] + b["width"] * b["height"] - inter
    return (x > 0) & (y > 0) & (inter / union > iou)


def _greedy(boxes: DataFrame, group: list[str], order: str, iou: float) -> DataFrame:
    """Whole groups of bounded size: sort by score, keep a box unless a kept one overlaps it."""
    rest = [c for c in boxes.columns if c not in group]
    item = F.struct((-F.col("confidence")).alias("_rank"), F.col(order).alias("_order"), *rest)
    ranked = boxes.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("_boxes"))
    kept = F.aggregate(
        F.slice("_boxes", 2, F.size("_boxes")),
        F.slice("_boxes", 1, 1),
        lambda keep, box: F.when(
            F.exists(keep, lambda k: overlap_exceeds(k, box, iou)), keep
        ).otherwise(F.concat(keep, F.array(box))),
    )
    return ranked.select(*group, F.inline(kept)).select(*boxes.columns)


def _cells(iou: float, widest: float) -> Column:
    """Grid cells of a box. Boxes that overlap by more than ``iou`` differ in their longer side by less than
    1 / iou; so sides fall into levels of that ratio, a box is entered into the grids of its own level
    and the next, and such a pair shares a cell of one of them. A cell is as wide as its level's
    longest side: a box lies in at most four cells of a grid."""
    if iou < 0.01:  # no bound on the sizes that overlap: one grid
        levels = [(F.lit(0), F.lit(float(widest)))]
    else:
        ratio = 1.001 / iou
        own = F.floor(F.log(F.greatest("width", "height")) / F.log(F.lit(ratio))).cast("int")
        levels = [(own + n, F.pow(F.lit(ratio), own + n + 1)) for n in (0, 1)]

    def grid(level: Column, side: Column) -> Column:
        span = lambda low, size: F.sequence(F.floor(F.col(low) / side), F.floor((F.col(low) + F.col(size)) / side))
        across = F.transform(span("left", "width"), lambda x: F.transform(
            span("top", "height"), lambda y: F.struct(level.alias("level"), x.alias("x"), y.alias("y"))
        ))
        return F.flatten(across)

    return F.concat(*[grid(*level) for level in levels])


def _in_cell_rounds(boxes: DataFrame, group: list[str], order: str, iou: float, depth: int) -> DataFrame:
    """Oversized groups, exactly, in rounds over a grid.

    In a round every cell looks at its ``depth`` best undecided boxes. A box that is among them in
    all of its cells and overlaps none of those ranked above it is kept: no undecided box can
    suppress it any more. Then each undecided box that a newly kept one overlaps goes. The best
    box of a group is always decided, and boxes far apart are decided in the same round, so rounds
    follow the depth of overlapping chains, not the size of a group. No task holds more than
    ``depth`` boxes of a cell, and no pairs of boxes are formed.
    """
    rest = [c for c in boxes.columns if c not in (*group, "confidence", order)]
    numbered = sliced_row_number(boxes, group, [F.desc("confidence"), F.col(order), *map(F.col, rest)], "_r")
    numbered = materialize(numbered, "nms-boxes")
    corners, key = ["left", "top", "width", "height"], [*group, "_r"]
    flat = (F.col("width") > 0) & (F.col("height") > 0)
    usable = F.coalesce(flat & F.col("left").isNotNull() & F.col("top").isNotNull(), F.lit(False))
    widest = numbered.agg(F.max(F.greatest("width", "height"))).first()[0] or 1.0
    placed = numbered.filter(usable).select(*key, *corners).withColumn("_cells", _cells(iou, widest))
    left = materialize(placed, "nms-left")
    item = F.struct("_r", F.size("_cells").alias("n"), *corners)
    kept = [numbered.filter(~usable).select(*key)]  # empty boxes overlap nothing
    while not left.isEmpty():
        rows = left.select(*group, item.alias("b"), F.explode("_cells").alias("_cell"))
        place = F.row_number().over(W.partitionBy(*group, "_cell").orderBy("b._r"))
        best = rows.withColumn("_n", place).filter(F.col("_n") <= depth)
        lists = best.groupBy(*group, "_cell").agg(F.array_sort(F.collect_list("b")).alias("l"))
        clear = F.transform("l", lambda b, i: F.struct(
            b.alias("b"), (~F.exists(F.slice("l", F.lit(1), i), lambda a: overlap_exceeds(a, b, iou))).alias("clear")
        ))
        votes = lists.select(*group, F.inline(clear)).groupBy(*group, "b").agg(F.sum(F.col("clear").cast("int")).alias("votes"))
        new = materialize(votes.filter(F.col("votes") == F.col("b.n")).select(*group, "b"), "nms-kept")
        kept.append(new.select(*group, "b._r"))
        cells = new.select(*group, "b.*").withColumn("_cells", _cells(iou, widest)).select(
            *group, F.explode("_cells").alias("_cell"), F.struct("_r", *corners).alias("k")
        ).groupBy(*group, "_cell").agg(F.collect_list("k").alias("_k"))
        # a kept box was among the first ``depth`` of its cells, so lists are short; it overlaps itself
        gone = rows.join(cells, [*group, "_cell"]).filter(
            F.exists("_k", lambda k: (k["_r"] == F.col("b._r")) | overlap_exceeds(k, F.col("b"), iou))
        ).select(*group, "b._r").distinct()
        left = materialize(left.join(gone, key, "left_anti").select(*left.columns), "nms-left")
    ids = kept[0]
    for part in kept[1:]:
        ids = ids.unionByName(part)
    return numbered.join(ids, key, "left_semi").select(*boxes.columns)


def suppress(
    detections: DataFrame,
    iou: float = NMS_IOU,
    keys: Sequence[str] = FRAME_KEYS,
    per_class: str = "class_id",
    order: str = "det_order",
    hot: HotKeys | None = None,
    block: int = CELL_BOXES,
) -> DataFrame:
    """Boxes that survive suppression within their frame and class.

    Sorted by confidence (descending) then list position; a box goes when its IoU
    with a kept box is above ``iou``. Apply the confidence filter first.
    """
    group = [*keys, per_class]
    if hot is None and not detections.isStreaming:
        hot = find_hot_keys(detections, group, HOT_BOXES)
    return split_hot(
        detections, group, hot,
        lambda rows: _greedy(rows, group, order, iou),
        lambda rows: _in_cell_rounds(rows, group, order, iou, block),
    )
