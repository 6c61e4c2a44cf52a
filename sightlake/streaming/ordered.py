"""Per-stream state that sees rows in order of event time, whatever order they arrive in.

Rows wait in state as sorted runs, cut into blocks. A timer at the end of a run's first bucket of event time
releases all buckets that the watermark has passed: the runs are merged, so rows are taken in (event time,
arrival) order. Files in any order and rows late within the lateness budget give the same result as one
sorted pass, however they fall into micro-batches. State is read and written a block at a time, and
``FAN_IN`` runs of a level become one of the next, so that the work grows with the rows (times the few
levels) and at most two blocks of a run, or the rows of one run to be, are in memory.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

RUN_ROWS = 131_072
BLOCK_ROWS = 8_192
FAN_IN = 16
_RUN = T.StructType([T.StructField("run", T.LongType())])
_BLOCK = T.StructType([T.StructField("run", T.LongType()), T.StructField("block", T.LongType())])
# blocks [first, end) wait; bucket of their first row
_PLACE = T.StructType([T.StructField(c, T.LongType()) for c in ("level", "first", "end", "bucket")])
_BYTES = T.StructType([T.StructField("value", T.BinaryType())])


def _joined(parts: list[pd.DataFrame]) -> pd.DataFrame:
    """Integers stay exact where other parts have NULLs (and so doubles) in their column."""
    for c in parts[0].columns:
        kinds = {p[c].dtype for p in parts}
        if len(kinds) > 1 and any(pd.api.types.is_integer_dtype(k) for k in kinds):
            parts = [p.assign(**{c: p[c].astype("Int64")}) for p in parts]
    return pd.concat(parts)


class Ordered(StatefulProcessor):
    """Buffers rows and hands them to ``step`` in order, in slices of any size.

    ``step`` gets rows and what it returned for the stream before (``fresh()`` at first), and
    returns the rows to emit and what to keep. What is kept is written back after every release, so
    it has to be bounded.
    """

    def __init__(self, columns: Sequence[str], arrival: str, bucket_ms: int, time: str = "event_time", order: Sequence[str] = ()):
        self.columns, self.bucket_ms, self.time = list(columns), bucket_ms, time
        self.order = [time, arrival, *order]

    def fresh(self):
        return None

    def step(self, rows: pd.DataFrame, kept) -> tuple[pd.DataFrame, object]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", _BLOCK, _BYTES)
        self.places = handle.getMapState("runs", _RUN, _PLACE)
        self.kept = handle.getValueState("kept", _BYTES)

    def _runs(self) -> dict[int, list[int]]:
        return {run: list(place) for (run,), place in self.places.iterator()}

    def _buckets(self, rows: pd.DataFrame) -> np.ndarray:
        return (rows[self.time].astype("datetime64[us]").astype("int64") // 1000 // self.bucket_ms).to_numpy()

    def _sorted(self, parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = _joined(parts) if len(parts) > 1 else parts[0]
        return rows.sort_values(self.order, kind="stable", ignore_index=True)

    def _place(self, runs: dict[int, list[int]], run: int, place: list[int]) -> None:
        runs[run] = place
        self.places.updateValue((run,), tuple(place))
        self.handle.registerTimer((place[3] + 1) * self.bucket_ms)

    def _add(self, runs: dict[int, list[int]], slices: Iterable[pd.DataFrame], level: int = 0) -> None:
        """A new run of sorted slices."""
        run, end, bucket = max(runs, default=-1) + 1, 0, None
        for rows in slices:
            if bucket is None:
                bucket = int(self._buckets(rows.iloc[:1])[0])
            for at in range(0, len(rows), BLOCK_ROWS):
                self.blocks.updateValue((run, end), (pickle.dumps(rows.iloc[at : at + BLOCK_ROWS]),))
                end += 1
        self._place(runs, run, [level, 0, end, bucket])
        peers = [r for r, place in runs.items() if place[0] == level]
        if len(peers) >= FAN_IN:
            self._add(runs, self._taken(runs, peers), level + 1)

    def _taken(self, runs: dict[int, list[int]], chosen: list[int], last: int | None = None) -> Iterator[pd.DataFrame]:
        """Rows of the chosen runs up to bucket ``last``, merged in order and removed from the state."""
        held, going = None, True
        while going:
            parts = [] if held is None else [held]
            for run in chosen:
                n = 0 if held is None else int((held["_run"] == run).sum())
                place = runs[run]
                while place[1] < place[2] and n < BLOCK_ROWS:
                    parts.append(pickle.loads(self.blocks.getValue((run, place[1]))[0]).assign(_run=run))
                    self.blocks.removeKey((run, place[1]))
                    place[1] += 1
                    n += len(parts[-1])
            held = self._sorted(parts)
            # complete up to the first row that is the last one read of a run with more blocks
            of = held["_run"].to_numpy()
            ends = [int(np.flatnonzero(of == run)[-1]) + 1 for run in chosen if runs[run][1] < runs[run][2]]
            ready = due = min(ends, default=len(held))
            if last is not None:
                due = int((self._buckets(held.iloc[:ready]) <= last).sum())
            if due:
                yield held.iloc[:due].drop(columns="_run")
            held, going = held.iloc[due:], due == ready and bool(ends)
        for run in chosen:
            rest = held[held["_run"] == run].drop(columns="_run")
            level, first, end, _ = runs.pop(run)
            if len(rest):
                self.blocks.updateValue((run, first - 1), (pickle.dumps(rest),))
                self._place(runs, run, [level, first - 1, end, int(self._buckets(rest.iloc[:1])[0])])
            else:
                self.places.removeKey((run,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        runs, parts = self._runs(), []
        for chunk in rows:
            if len(chunk):
                parts.append(chunk)
            if sum(map(len, parts)) >= RUN_ROWS:
                self._add(runs, [self._sorted(parts)])
                parts = []
        if parts:
            self._add(runs, [self._sorted(parts)])
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = timerValues.getCurrentWatermarkInMs() // self.bucket_ms - 1
        runs = self._runs()
        due = [run for run, place in runs.items() if place[3] <= last]
        if not due:  # another run's timer has released them
            return
        kept = pickle.loads(self.kept.get()[0]) if self.kept.exists() else self.fresh()
        for rows in self._taken(runs, due, last):
            out, kept = self.step(rows, kept)
            yield out[self.columns]
        self.kept.update((pickle.dumps(kept),))

    def close(self) -> None:
        pass


class IntervalSampler(Ordered):
    """Keeps the last emitted time. Rows whose own time is unknown are placed by event time."""

    def __init__(self, interval: int, value: str, *args, **kwargs):
        super().__init__(*args, **kwargs)
        self.interval, self.value = interval, value

    def step(self, rows, kept):
        own = rows[self.value].fillna(rows[self.time].astype("datetime64[us]").astype("int64")).astype("int64")
        keep = []
        for t in own:
            passes = self.interval == 0 or (self.interval > 0 and (kept is None or t - kept >= self.interval))
            kept = t if passes else kept
            keep.append(passes)
        return rows[keep], kept


class Sequencer(Ordered):
    """Keeps the next message number."""

    def fresh(self):
        return 0

    def step(self, rows, kept):
        return rows.assign(seq=range(kept, kept + len(rows))), kept + len(rows)


class FirstWins(Ordered):
    """Keeps the keys of the newest ``limit`` first puts; a put of one of them changes nothing."""

    def __init__(self, keys: Sequence[str], limit: int, *args, **kwargs):
        super().__init__(*args, **kwargs)
        self.keys, self.limit = list(keys), limit

    def fresh(self):
        return {}

    def step(self, rows, kept):
        keep = []
        for key in rows[self.keys].itertuples(index=False, name=None):
            keep.append(key not in kept)
            if keep[-1]:
                kept[key] = None
                if len(kept) > self.limit:
                    del kept[next(iter(kept))]
        return rows[keep], kept


class OneShotMatch(Ordered):
    """Keeps the put that waits under each buffer key, the ``limit`` newest ones. A payload takes and
    removes the put of its key."""

    def __init__(self, key: str, side: str, brought: Sequence[str], limit: int, *args, **kwargs):
        super().__init__(*args, **kwargs)
        self.key, self.side, self.brought, self.limit = key, side, list(brought), limit

    def fresh(self):
        return {}

    def step(self, rows, kept):
        matched, found = [], []
        puts = rows[self.brought].to_dict("records")
        for i, (key, side) in enumerate(zip(rows[self.key], rows[self.side])):
            if pd.isna(key):
                continue
            if side == 0:
                kept.pop(key, None)  # a repeated put is the newest again
                kept[key] = puts[i]
                if len(kept) > self.limit:
                    del kept[next(iter(kept))]
            elif key in kept:
                matched.append(i)
                found.append(kept.pop(key))
        out = rows.iloc[matched].drop(columns=self.brought).reset_index(drop=True)
        return pd.concat([out, pd.DataFrame(found, columns=self.brought)], axis=1), kept


def run(df: DataFrame, partition: Sequence[str], processor: Ordered, schema: T.StructType) -> DataFrame:
    """``processor`` over every group of ``partition``; ``df`` needs a watermark on its event time."""
    return df.groupBy(*partition).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="eventTime"
    )
