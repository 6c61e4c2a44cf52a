"""Thinning of streams: greedy interval sampling and newest-per-tick.

Greedy sampling emits a row when at least ``interval`` has passed since the last
emitted row, so every decision depends on the one before. It is still computed in
parallel: time is cut into chunks, each chunk is summarised as the function "earliest
time a row may be emitted on entry -> the same on exit", the functions are composed
over runs of chunks and then per stream, and finally every chunk replays its own
rows from its now known entry. A summary holds no more steps than there are distinct
times in the first interval of its chunk, because no entry can lie beyond that. Streams
with more than ``INTERVAL_ROWS`` rows in any interval go another way (``dense_times``),
so a group holds at most ``CHUNK_INTERVALS`` times as many.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..constants import FRAME_KEYS
from ..session import materialize
from ..skew import HotKeys, bucket_of, find_hot_keys, no_hot_keys
from .dense_times import emitted_times

CHUNK_INTERVALS = 256
INTERVAL_ROWS = 2_048
RUN_CHUNKS = 256
_OPEN = np.iinfo(np.int64).min


def _steps(upto: np.ndarray, leave: np.ndarray, start: int, interval: int):
    """Drop steps no entry can reach and merge neighbours with the same exit."""
    reach = int(np.searchsorted(upto, start + interval)) + 1
    upto, leave = upto[:reach], leave[:reach]
    last_of_run = np.append(leave[1:] != leave[:-1], True)
    return upto[last_of_run], leave[last_of_run]


def _chunk_steps(times: np.ndarray, start: int, interval: int):
    following = np.searchsorted(times, times + interval)
    last = np.where(following == len(times), np.arange(len(times)), following)
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    return _steps(times, times[last] + interval, start, interval)


def _apply(upto: np.ndarray, leave: np.ndarray, entry):
    at = np.searchsorted(upto, entry)
    return np.where(at < len(upto), leave[np.minimum(at, len(upto) - 1)], entry)


def _compose(parts: list[tuple[int, np.ndarray, np.ndarray]], interval: int):
    """Steps of consecutive chunks, each with its start, as the steps of all of them."""
    _, upto, leave = parts[-1]
    for start, before, exits in reversed(parts[:-1]):
        upto, leave = (
            np.concatenate([before, upto]), np.concatenate([_apply(upto, leave, exits), leave])
        )
        upto, leave = _steps(upto, leave, start, interval)
    return upto, leave


def dense_streams(
    rows: DataFrame, interval: int, partition: Sequence[str] = ("stream_id",), time: str = "ts_us",
    limit: int | None = None,
) -> HotKeys:
    """Streams with over ``limit`` rows in one interval. Counts are combined before the shuffle."""
    limit = INTERVAL_ROWS if limit is None else limit
    if interval <= limit:  # an interval cannot hold more times than units
        return no_hot_keys(partition)
    cells = rows.select(*partition, bucket_of(time, interval).alias("_cell"))
    dense = find_hot_keys(cells, [*partition, "_cell"], limit)
    if not dense.present:
        return no_hot_keys(partition)
    return HotKeys(tuple(partition), dense.table.select(*partition).distinct(), dense.small)


def _times(rows: DataFrame, partition: list[str], time: str, arrival: str) -> DataFrame:
    # of rows with equal time only the first to arrive can pass; one aggregate serves both uses
    return rows.groupBy(*partition, F.col(time).alias("t")).agg(F.min(arrival).alias("first"))


def _emitted_dense(rows: DataFrame, interval: int, partition: list[str], time: str, arrival: str) -> DataFrame:
    times = _times(rows, partition, time, arrival)
    return times.join(emitted_times(times, interval, partition), [*partition, "t"], "left_semi")


def _emitted(
    rows: DataFrame, interval: int, partition: list[str], time: str, arrival: str, chunk_intervals: int
) -> DataFrame:
    width = interval * chunk_intervals
    run_width = width * RUN_CHUNKS
    keys = ", ".join(rows.select(*partition).schema[p].simpleString().replace(":", " ", 1) for p in partition)
    times = _times(rows, partition, time, arrival).withColumns(
        {"chunk": bucket_of("t", width), "run": bucket_of("t", run_width)}
    )

    def head(pdf: pd.DataFrame, n: int, *extra: str) -> dict:
        return {c: [pdf[c].iloc[0]] * n for c in (*partition, *extra)}

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        start = int(pdf["chunk"].iloc[0]) * width
        upto, leave = _chunk_steps(np.sort(pdf["t"].to_numpy()), start, interval)
        return pd.DataFrame({**head(pdf, len(upto), "run", "chunk"), "upto": upto, "leave": leave})

    def by_part(pdf: pd.DataFrame, part: str):
        pdf = pdf.sort_values([part, "upto"])
        for number, rows_ in pdf.groupby(part, sort=True):
            yield number, (rows_["upto"].to_numpy(), rows_["leave"].to_numpy())

    def compose_run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [(int(number) * width, *steps) for number, steps in by_part(pdf, "chunk")]
        upto, leave = _compose(parts, interval)
        return pd.DataFrame({**head(pdf, len(upto), "run"), "upto": upto, "leave": leave})

    def walk(pdf: pd.DataFrame, part: str, entry: int) -> pd.DataFrame:
        numbers, entries = [], []
        for number, (upto, leave) in by_part(pdf, part):
            numbers.append(number)
            entries.append(entry)
            entry = int(_apply(upto, leave, np.int64(entry)))
        return pd.DataFrame({**head(pdf, len(numbers)), part: numbers, "entry": entries})

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t, out = pdf["t"].to_numpy(), []
        at = int(np.searchsorted(t, int(pdf["entry"].iloc[0])))
        while at < len(t):
            out.append(at)
            at = int(np.searchsorted(t, t[at] + interval))
        return pdf.iloc[out][[*partition, "t", "first"]]

    steps = "upto bigint, leave bigint"
    chunks = times.groupBy(*partition, "run", "chunk").applyInPandas(
        summarise, f"{keys}, run bigint, chunk bigint, {steps}"
    )
    runs = chunks.groupBy(*partition, "run").applyInPandas(compose_run, f"{keys}, run bigint, {steps}")
    run_entries = runs.groupBy(*partition).applyInPandas(
        lambda pdf: walk(pdf, "run", _OPEN), f"{keys}, run bigint, entry bigint"
    )
    chunk_entries = chunks.join(run_entries, [*partition, "run"]).groupBy(*partition, "run").applyInPandas(
        lambda pdf: walk(pdf, "chunk", int(pdf["entry"].iloc[0])), f"{keys}, chunk bigint, entry bigint"
    )
    return times.join(chunk_entries, [*partition, "chunk"]).groupBy(*partition, "chunk").applyInPandas(
        replay, f"{keys}, t bigint, first bigint"
    )


def interval_sample(
    rows: DataFrame,
    interval: int,
    partition: Sequence[str] = ("stream_id",),
    time: str = "ts_us",
    arrival: str = "arrival_seq",
    chunk_intervals: int = CHUNK_INTERVALS,
    dense: HotKeys | None = None,
) -> DataFrame:
    """Rows a greedy sampler lets through. Negative interval: none; 0: all.

    The first row of a stream always passes. Of rows with equal time only the first
    to arrive can pass, of rows without a time none. ``dense`` are the ``dense_streams``, counted here if not given.
    """
    if interval < 0:
        return rows.filter(F.lit(False))
    if interval == 0:
        return rows
    partition = list(partition)
    timed = rows.filter(F.col(time).isNotNull()).select(*partition, time, arrival)
    if dense is None:
        dense = dense_streams(timed, interval, partition, time)
    emitted = _emitted(dense.exclude(timed) if dense.present else timed, interval, partition, time, arrival, chunk_intervals)
    if dense.present:
        emitted = emitted.unionByName(_emitted_dense(dense.only(timed), interval, partition, time, arrival))
    passed = emitted.withColumnsRenamed({"t": time, "first": arrival})
    return rows.join(passed, [*partition, time, arrival], "left_semi").select(*rows.columns)


def interval_sample_frames(
    rows: DataFrame,
    interval: int,
    keys: Sequence[str] = FRAME_KEYS,
    time: str = "ts_us",
    arrival: str = "arrival_seq",
) -> DataFrame:
    """Interval sampling of frames: every row of a sampled frame passes.

    One narrow row per frame is written, as sampling reads its rows many times; ``rows`` are read twice."""
    if interval < 0:
        return rows.filter(F.lit(False))
    if interval == 0:
        return rows
    frames = rows.groupBy(*keys).agg(F.min(time).alias(time), F.min(arrival).alias(arrival))
    sampled = interval_sample(materialize(frames, "frame-times"), interval, keys[:-1], time, arrival)
    return rows.join(sampled.select(*keys), list(keys), "left_semi").select(*rows.columns)


def latest_per_tick(
    rows: DataFrame,
    tick: int,
    partition: Sequence[str] = ("stream_id", "stage"),
    time: str = "ts_us",
    arrival: str = "arrival_seq",
) -> DataFrame:
    """The newest row per stream, stage and tick. Combined before the shuffle."""
    opened = F.col(time) - F.pmod(F.col(time), F.lit(tick))
    rest = [c for c in rows.columns if c not in partition]
    newest = F.max_by(F.struct(*rest), F.struct(time, arrival)).alias("_row")
    return rows.groupBy(*partition, opened.alias("tick_us")).agg(newest).select(
        *partition, "tick_us", "_row.*"
    )
