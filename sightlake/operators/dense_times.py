"""Greedy sampling of streams with very many times inside one interval.

Every time has one successor, the first time at least an interval later. Blocks of one
interval hold at most one emitted time each, so a link from a block's possible first times to
the first time after the block is the whole of what must be known of it. Two neighbouring
blocks are joined by following the second one's link from the first one's; only times that can be
first in the joined block keep their link, so each level has about half the rows of the one
before, however the rows are spread. When few links are left they are walked from the
stream's first time, and the levels are then unfolded downwards. All of it is range slices and
equi-joins: no group holds more than ``WALK_LINKS`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize
from ..skew import ordered_slices

WALK_LINKS = 262_144
_LAST = 2**63 - 1


def _nearest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, before: bool, out: str) -> DataFrame:
    """The nearest non-NULL ``value`` in earlier rows (``before``) or in this and later ones, given
    rows in ascending order of it, over range slices: each is sorted alone and takes what it lacks
    from the slices beyond it."""
    order = list(order) if before else [c.desc() for c in order]
    inside = W.partitionBy(*keys, "_segment").orderBy(*order)
    inside = inside.rowsBetween(W.unboundedPreceding, -1 if before else W.currentRow)
    beyond = W.partitionBy(*keys).orderBy(F.col("_segment") if before else F.col("_segment").desc())
    slices = df.groupBy(*keys, "_segment").agg((F.max if before else F.min)(value).alias("_edge"))
    edges = slices.select(
        *keys, "_segment",
        F.last("_edge", ignorenulls=True).over(beyond.rowsBetween(W.unboundedPreceding, -1)).alias("_carried"),
    )
    found = df.withColumn("_inside", F.last(value, ignorenulls=True).over(inside)).join(edges, [*keys, "_segment"])
    return found.withColumn(out, F.coalesce("_inside", "_carried")).drop("_inside", "_carried", "_segment")


def successors(times: DataFrame, interval: int, keys: Sequence[str]) -> DataFrame:
    """Distinct times ``t`` with the time before (``prev``), the first one at least ``interval`` later
    (``to``) and the stream's first time (``origin``)."""
    keys = list(keys)
    slim = times.select(*keys, "t")
    sliced = ordered_slices(slim, keys, [F.col("t")])
    placed = _nearest(sliced, keys, [F.col("t")], "t", True, "prev")
    # rows before probes of the same value when read backwards: a time exactly an interval later counts
    rows = slim.select(*keys, F.col("t").alias("at"), F.lit(1).alias("side"), F.col("t").alias("row"))
    probes = placed.filter(F.col("t") <= F.lit(_LAST - interval)).select(
        *keys, (F.col("t") + F.lit(interval)).alias("at"), F.lit(0).alias("side"), "t", "prev"
    )
    ends = placed.filter(F.col("t") > F.lit(_LAST - interval)).select(
        *keys, "t", "prev", F.lit(None).cast("bigint").alias("to")
    )
    both = ordered_slices(rows.unionByName(probes, allowMissingColumns=True), keys, [F.col("at"), F.col("side")])
    linked = _nearest(both, keys, [F.col("at"), F.col("side")], "row", False, "to").filter("side = 0")
    origin = slim.groupBy(*keys).agg(F.min("t").alias("origin"))
    return linked.select(*keys, "t", "prev", "to").unionByName(ends).join(origin, keys)


def _block(time: str, width: int) -> Column:
    return F.call_function("div", F.col(time) - F.col("origin"), F.lit(width).cast("bigint"))


def _joined(links: DataFrame, width: int, interval: int, keys: list[str]) -> DataFrame:
    """Links of blocks of ``width`` from links of blocks half as wide."""
    number, opened = _block("t", width), F.col("origin") + _block("t", width) * F.lit(width).cast("bigint")
    # an entry is less than an interval behind the opening: no time beyond the first one after that is first
    can_be_first = F.col("prev").isNull() | ((number > 0) & (F.col("prev") - opened < F.lit(interval)))
    second = links.select(*keys, F.col("t").alias("to"), F.col("to").alias("_further"), F.lit(True).alias("_has"))
    within = F.col("_has") & (_block("to", width) == number)
    return links.filter(can_be_first).join(second, [*keys, "to"], "left").select(
        *keys, "t", "prev", F.when(within, F.col("_further")).otherwise(F.col("to")).alias("to"), "origin"
    )


def _walk(links: DataFrame, keys: list[str]) -> DataFrame:
    """The times reached from each stream's first one."""
    schema = links.select(*keys, "t").schema

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ignore_index=True)
        follow = pdf["t"].searchsorted(pdf["to"])
        reached, at = [], 0
        while at < len(pdf):
            reached.append(at)
            at = int(follow[at])
        return pdf.iloc[reached][[*keys, "t"]]

    closed = links.select(*keys, "t", F.coalesce("to", F.lit(_LAST)).alias("to"))
    return closed.groupBy(*keys).applyInPandas(walk, schema)


def emitted_times(times: DataFrame, interval: int, keys: Sequence[str], walk_links: int | None = None) -> DataFrame:
    """Of distinct times ``t`` per ``keys`` those that a greedy sampler lets through."""
    keys = list(keys)
    walk_links = WALK_LINKS if walk_links is None else walk_links
    levels, width = [materialize(successors(times, interval, keys), "time-links")], interval
    while not levels[-1].groupBy(*keys).count().filter(F.col("count") > walk_links).isEmpty():
        width *= 2
        levels.append(materialize(_joined(levels[-1], width, interval, keys), "time-links"))
    reached = _walk(levels.pop(), keys)
    while levels:
        # a block joined of two: its first time is known, the second one's follows if it lies inside
        links = levels.pop()
        at = links.join(reached, [*keys, "t"], "left_semi").filter(F.col("to").isNotNull())
        inner = at.filter(_block("to", width) == _block("t", width)).select(*keys, F.col("to").alias("t"))
        reached = materialize(reached.unionByName(inner), "times-reached")
        width //= 2
    return reached
