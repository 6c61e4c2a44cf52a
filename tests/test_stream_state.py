"""Order-dependent stream state: the step functions against plain replays, in buckets of any size."""

import numpy as np
import pandas as pd
import pytest

from sightlake.streaming import ordered as O

COLUMNS = ["stream_id", "frame", "arrival_seq", "event_time"]


def frame(times, keys, sides=None):
    rows = pd.DataFrame({"stream_id": 0, "frame": keys, "arrival_seq": range(len(times)), "event_time": pd.to_datetime(times, unit="us")})
    if sides is not None:
        rows = rows.assign(side=sides, log=[f"put {i}" if s == 0 else None for i, s in enumerate(sides)])
    return rows.sort_values(["event_time", "arrival_seq", *(["side"] if sides is not None else [])], kind="stable")


def replay(processor, rows, size):
    kept, out = processor.fresh(), []
    for i in range(0, len(rows), size):
        part, kept = processor.step(rows.iloc[i : i + size], kept)
        out.append(part)
    return pd.concat(out) if out else rows


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_first_wins_by_count(size):
    rng = np.random.default_rng(1)
    rows = frame(rng.integers(0, 10**6, 600), rng.integers(0, 40, 600))
    got = replay(O.FirstWins(["frame"], 16, COLUMNS, "arrival_seq", 1000), rows, size)
    store, want = {}, []
    for r in rows.itertuples():
        if r.frame not in store:
            want.append(r.arrival_seq)
            store[r.frame] = 1
            if len(store) > 16:
                del store[next(iter(store))]
    assert got.arrival_seq.tolist() == want and len(want) > 16


def test_first_wins_after_any_gap():
    rows = frame([0, 10**6 * 86_400 * 365, 10**6 * 86_400 * 366], [5, 6, 5])
    assert replay(O.FirstWins(["frame"], 2, COLUMNS, "arrival_seq", 1000), rows, 1).frame.tolist() == [5, 6]
    assert replay(O.FirstWins(["frame"], 1, COLUMNS, "arrival_seq", 1000), rows, 1).frame.tolist() == [5, 6, 5]


@pytest.mark.parametrize("size", [1, 5, 1000])
@pytest.mark.parametrize("limit", [3, 512])
def test_one_shot_match(size, limit):
    rng = np.random.default_rng(2)
    keys = [None if k == 9 else int(k) for k in rng.integers(0, 10, 400)]
    rows = frame(rng.integers(0, 300, 400), pd.array(keys, dtype="Int64"), rng.integers(0, 2, 400))
    columns = ["stream_id", "frame", "arrival_seq", "event_time", "log"]
    got = replay(O.OneShotMatch("frame", "side", ["log"], limit, columns, "arrival_seq", 1000), rows, size)
    store, want = {}, []
    for r in rows.itertuples():
        if r.frame is pd.NA:
            continue
        if r.side == 0:
            store.pop(r.frame, None)
            store[r.frame] = r.log
            if len(store) > limit:
                del store[next(iter(store))]
        elif r.frame in store:
            want.append((r.arrival_seq, store.pop(r.frame)))
    assert list(zip(got.arrival_seq, got.log)) == want and len(want) > 40


@pytest.mark.parametrize("interval", [-1, 0, 1000])
def test_sampler_and_numbers(interval):
    rng = np.random.default_rng(3)
    rows = frame(rng.integers(0, 50_000, 300), range(300))
    own = rows.event_time.astype("datetime64[us]").astype("int64")
    rows = rows.assign(ts_us=own.where(rows.arrival_seq % 9 != 4))  # some source times are unknown
    last, want = None, []
    for t, n in zip(own, rows.arrival_seq):
        if interval == 0 or (interval > 0 and (last is None or t - last >= interval)):
            last = t
            want.append(n)
    sampler = O.IntervalSampler(interval, "ts_us", COLUMNS, "arrival_seq", 1000)
    assert replay(sampler, rows, 11).arrival_seq.tolist() == want
    numbered = replay(O.Sequencer([*COLUMNS, "seq"], "arrival_seq", 1000), rows, 13)
    assert numbered.seq.tolist() == list(range(300))
