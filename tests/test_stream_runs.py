"""Waiting stream state: merged in order, in few reads and writes."""

import numpy as np
import pandas as pd
import pytest

from sightlake.streaming import ordered as O


class State:
    """The handle of a stateful processor, its variables and timers in dictionaries; counts calls."""

    def __init__(self):
        self.calls, self.timers, self.watermark = 0, set(), 0

    def getMapState(self, *args):
        return Variable(self)

    getValueState = getMapState

    def registerTimer(self, expiry):
        self.calls += 1
        self.timers.add(expiry)

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def getExpiryTimeInMs(self):
        return self.expiry

    def release(self, processor, watermark):
        """Expired timers, as Spark runs them after a batch's rows."""
        self.watermark, out = watermark, []
        for self.expiry in sorted(t for t in self.timers if t <= watermark):
            out += processor.handleExpiredTimer((0,), self, self)
            self.timers.discard(self.expiry)
        return out


class Variable(dict):
    def __init__(self, state):
        self.state = state

    def counted(self, result, n=1):
        self.state.calls += n
        return result

    def getValue(self, key): return self.counted(self[key])  # noqa: E704
    def containsKey(self, key): return self.counted(key in self)  # noqa: E704
    def updateValue(self, key, value): self.counted(self.__setitem__(key, value))  # noqa: E704
    def removeKey(self, key): self.counted(self.pop(key))  # noqa: E704
    def keys(self): return self.counted(list(dict.keys(self)), len(self))  # noqa: E704
    def iterator(self): return iter(self.counted(list(self.items()), len(self)))  # noqa: E704
    def exists(self): return None in self  # noqa: E704
    def get(self): return self[None]  # noqa: E704
    def update(self, value): self.updateValue(None, value)  # noqa: E704


def run(chunks, marks, size=1000):
    state, out = State(), []
    processor = O.Sequencer(["stream_id", "n", "own", "event_time", "seq"], "n", size)
    processor.init(state)
    for chunk, mark in zip(chunks, marks):
        list(processor.handleInputRows((0,), iter(chunk), state))
        out += state.release(processor, mark)
    return pd.concat(out), state, processor


def disordered(n, span_ms, seed=4):
    rng = np.random.default_rng(seed)
    us = rng.integers(0, span_ms * 1000, n)
    return pd.DataFrame({"stream_id": 0, "n": rng.permutation(n), "own": us + 2**60 + 1, "event_time": pd.to_datetime(us, unit="us")})


def test_calls_grow_with_rows_not_with_buckets():
    rows = disordered(20_000, 2_000_000)  # 2,000 buckets, none with more than a few rows of a chunk
    chunks = [[rows.iloc[i : i + 1000] for i in range(0, len(rows), 1000)], []]
    got, state, _ = run(chunks, [0, 3_000_000])
    want = rows.sort_values(["event_time", "n"])
    assert got.n.tolist() == want.n.tolist() and got.seq.tolist() == list(range(len(rows)))
    assert state.calls < 500


@pytest.mark.parametrize("block,fan", [(1, 2), (7, 3), (100, 16)])
def test_runs_of_any_size(monkeypatch, block, fan):
    for name, value in {"BLOCK_ROWS": block, "FAN_IN": fan, "RUN_ROWS": 40}.items():
        monkeypatch.setattr(O, name, value, raising=False)
    rows = disordered(600, 60_000)
    rows.loc[::5, "event_time"] = rows.event_time.iloc[0]  # many rows of one time
    ms = rows.event_time.astype("datetime64[us]").astype("int64") // 1000
    parts = [rows.iloc[i : i + 30] for i in range(0, 600, 30)]
    parts[3] = parts[3].assign(own=parts[3].own.astype("Int64").where(parts[3].n % 2 == 0))
    marks, batches, late = [], [], []
    for i, part in enumerate(parts):  # rows behind the watermark are dropped by Spark
        mark = marks[-1] if marks else 0
        kept = part[ms.loc[part.index] >= mark]
        late.append(kept)
        batches.append([kept])
        marks.append(max(mark, (i - 8) * 3_700))
    got, state, processor = run([*batches, []], [*marks, 100_000])
    want = pd.concat(late).sort_values(["event_time", "n"])
    assert got.n.tolist() == want.n.tolist()
    exact = dict(zip(rows.n, rows.own))
    assert all(pd.isna(v) or int(v) == exact[n] for n, v in zip(got.n, got.own))
    assert not processor.blocks and not processor.places and not state.timers
