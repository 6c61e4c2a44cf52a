"""Ordered work on groups of any size.

Two situations need care. A *frame* normally holds a handful of objects, so one
shuffle on the frame key is right, but a single frame may hold a large share of
all rows: those keys are found by a pre-aggregated count and take a second,
range-partitioned way (``split_hot``). A *stream* is always large, so ordered
per-stream results are computed in buckets of the arrival number and stitched
together with a prefix sum over bucket totals (``bucketed_*``). Results are the
same on either way; nothing is dropped or capped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .session import materialize

HOT_GROUP_ROWS = 1_000_000
MAX_BROADCAST_KEYS = 10_000
BUCKET_ROWS = 65_536


def broadcast_if_small(df: DataFrame, limit: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """Mark for broadcast after counting; above ``limit`` rows the join stays a shuffle join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def broadcast_if(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


@dataclass(frozen=True)
class HotKeys:
    """Keys of groups above a row limit. ``table`` is None when there are none."""

    keys: tuple[str, ...]
    table: DataFrame | None = None
    small: bool = True

    @property
    def present(self) -> bool:
        return self.table is not None

    def _side(self) -> DataFrame:
        return broadcast_if(self.table, self.small)

    def exclude(self, df: DataFrame) -> DataFrame:
        return df.join(self._side(), list(self.keys), "left_anti").select(*df.columns)

    def only(self, df: DataFrame) -> DataFrame:
        return df.join(self._side(), list(self.keys), "left_semi").select(*df.columns)


def no_hot_keys(keys: Sequence[str]) -> HotKeys:
    return HotKeys(tuple(keys))


def find_hot_keys(df: DataFrame, keys: Sequence[str], limit: int = HOT_GROUP_ROWS) -> HotKeys:
    """Count rows per key (combined map-side) and keep the keys above ``limit``.

    At most rows/limit keys qualify. Up to MAX_BROADCAST_KEYS of them travel as a
    broadcast; beyond that they stay a table and are joined by shuffle.
    """
    keys = tuple(keys)
    spark = df.sparkSession
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).select(*keys)
    head = hot.limit(MAX_BROADCAST_KEYS + 1).collect()
    if not head:
        return no_hot_keys(keys)
    if len(head) <= MAX_BROADCAST_KEYS:
        return HotKeys(keys, spark.createDataFrame(head, hot.schema))
    return HotKeys(keys, materialize(hot, "hot-keys"), small=False)


def split_hot(
    df: DataFrame,
    keys: Sequence[str],
    hot: HotKeys | None,
    regular_way: Callable[[DataFrame], DataFrame],
    hot_way: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Run ``regular_way`` on ordinary groups and ``hot_way`` on the oversized ones."""
    if df.isStreaming:
        return regular_way(df)
    if hot is None:
        hot = find_hot_keys(df, keys)
    if not hot.present:
        return regular_way(df)
    return regular_way(hot.exclude(df)).unionByName(hot_way(hot.only(df)))


def ordered_slices(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Contiguous slices of (keys, order), numbered in order and fixed by a written table."""
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return materialize(ranged.withColumn("_segment", F.spark_partition_id()), "segments")


def _stitched_row_number(df: DataFrame, keys: list[str], part: str, order, out: str) -> DataFrame:
    totals = df.groupBy(*keys, part).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        *keys, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    local = df.withColumn("_local", F.row_number().over(W.partitionBy(*keys, part).orderBy(*order)))
    return (
        local.join(starts, [*keys, part])
        .withColumn(out, (F.col("_start") + F.col("_local")).cast("bigint"))
        .select(*[c for c in df.columns if c != part], out)
    )


def sliced_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """1-based position in groups of any size: range-partitioned slices plus a prefix sum."""
    keys, order = list(keys), list(order)
    return _stitched_row_number(ordered_slices(df, keys, order), keys, "_segment", order, out)


def group_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, hot: HotKeys | None = None
) -> DataFrame:
    """1-based position in the group; oversized groups are numbered slice by slice."""
    keys, order = list(keys), list(order)

    def regular(rows: DataFrame) -> DataFrame:
        number = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
        return rows.withColumn(out, number.cast("bigint"))

    return split_hot(df, keys, hot, regular, lambda rows: sliced_row_number(rows, keys, order, out))


def bucket_of(column: str, width: int = BUCKET_ROWS) -> Column:
    # integer arithmetic: a double quotient moves bucket edges of large numbers
    value, size = F.col(column).cast("bigint"), F.lit(width).cast("bigint")
    return F.call_function("div", value - F.pmod(value, size), size)


def bucketed_row_number(
    df: DataFrame, keys: Sequence[str], arrival: str, out: str, width: int = BUCKET_ROWS
) -> DataFrame:
    """1-based position by ``arrival`` in groups that are always large, such as streams.

    ``arrival`` is unique within the group, so a bucket holds at most ``width``
    rows whatever the group's size.
    """
    with_bucket = df.withColumn("_bucket", bucket_of(arrival, width))
    return _stitched_row_number(with_bucket, list(keys), "_bucket", [F.col(arrival)], out)


def bucketed_last_before(
    probe: DataFrame,
    puts: DataFrame,
    keys: Sequence[str],
    arrival: str,
    value: str,
    width: int = BUCKET_ROWS,
) -> DataFrame:
    """For each probe row, ``value`` of the newest put whose arrival is not later (as-of backward).

    A put that shares the probe's arrival number counts as earlier.
    """
    keys = list(keys)
    probes = probe.withColumn("_bucket", bucket_of(arrival, width))
    slim = puts.select(*keys, arrival, value).withColumn("_bucket", bucket_of(arrival, width))

    newest = slim.groupBy(*keys, "_bucket").agg(F.max_by(value, arrival).alias("_newest"))
    touched = (
        newest.select(*keys, "_bucket", "_newest")
        .unionByName(
            probes.select(*keys, "_bucket").distinct(), allowMissingColumns=True
        )
        .groupBy(*keys, "_bucket")
        .agg(F.max("_newest").alias("_newest"))
    )
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = touched.select(
        *keys, "_bucket", F.last("_newest", ignorenulls=True).over(earlier).alias("_carried")
    )

    probe_cols = [c for c in probes.columns if c not in (*keys, "_bucket", arrival)]
    both = probes.select(
        *keys, "_bucket", arrival, F.lit(1).alias("_side"), *probe_cols,
        F.lit(None).cast(puts.schema[value].dataType).alias("_value"),
    ).unionByName(
        slim.select(*keys, "_bucket", arrival, F.lit(0).alias("_side"), F.col(value).alias("_value")),
        allowMissingColumns=True,
    )
    so_far = (
        W.partitionBy(*keys, "_bucket").orderBy(arrival, "_side")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    seen = both.withColumn("_seen", F.last("_value", ignorenulls=True).over(so_far)).filter("_side = 1")
    return (
        seen.join(carried, [*keys, "_bucket"])
        .withColumn(f"latest_{value}", F.coalesce("_seen", "_carried"))
        .drop("_seen", "_carried", "_value", "_side", "_bucket")
    )
