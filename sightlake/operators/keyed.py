"""State keyed by frame or buffer: first/last wins, retention, and the joins built on it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..constants import FRAME_KEYS
from ..session import materialize
from ..skew import (
    BUCKET_ROWS, HOT_GROUP_ROWS, broadcast_if, broadcast_if_small, bucketed_last_before, find_hot_keys, ordered_slices,
)

BUFFER_KEYS = ("stream_id", "stage", "buf_key")


def _pick(df: DataFrame, keys: Sequence[str], arrival: str, extreme, choose) -> DataFrame:
    # one aggregate per column, not one per row struct: unused columns are pruned, and
    # numbers stay in hash aggregation. Arrival numbers are unique within a key.
    rest = [c for c in df.columns if c not in (*keys, arrival)]
    return df.groupBy(*keys).agg(
        extreme(arrival).alias(arrival), *[choose(c, arrival).alias(c) for c in rest]
    )


def first_wins(df: DataFrame, keys: Sequence[str] = FRAME_KEYS, arrival: str = "arrival_seq") -> DataFrame:
    """The first put per key; later puts change nothing. Combined before the shuffle."""
    return _pick(df, keys, arrival, F.min, F.min_by)


def last_wins(df: DataFrame, keys: Sequence[str] = FRAME_KEYS, arrival: str = "arrival_seq") -> DataFrame:
    """The latest put per key. Combined before the shuffle."""
    return _pick(df, keys, arrival, F.max, F.max_by)


def retain_newest(
    df: DataFrame,
    n: int,
    partition: Sequence[str] = ("stream_id",),
    keys: Sequence[str] = ("frame",),
    arrival: str = "arrival_seq",
    refresh: bool = True,
) -> DataFrame:
    """What a store bounded to ``n`` keys holds after all puts.

    With ``refresh`` a repeated put replaces the value and makes the key newest again. Without it
    the key keeps the age of its first put and takes the value of its last one, and a key put
    again after its eviction is a new one. Partitions without such a return, as frame numbers
    make them, need no replay: Spark cuts each task's rows to ``n`` before the shuffle. Others
    are replayed in arrival order, with ``n`` keys in memory.
    """
    if n <= 0:
        return df.limit(0)
    all_keys = [*partition, *keys]
    last = last_wins(df, all_keys, arrival)
    if refresh:
        return _newest(last.withColumn("_age", F.col(arrival)), n, partition)
    first = df.groupBy(*all_keys).agg(F.min(arrival).alias("_age"))
    aged = last.join(first, all_keys)
    returning = materialize(_returning(aged, n, partition, arrival), "returning")
    if returning.isEmpty():
        return _newest(aged, n, partition)
    side = broadcast_if_small(returning)
    puts = df.join(side, list(partition), "left_semi").select(*all_keys, arrival)
    held = _replay(puts, n, partition, keys, arrival)
    calm = aged.join(side, list(partition), "left_anti").select(*aged.columns)
    return _newest(calm, n, partition).unionByName(df.join(held, [*all_keys, arrival], "left_semi").select(*last.columns))


def _newest(aged: DataFrame, n: int, partition: Sequence[str]) -> DataFrame:
    newest = W.partitionBy(*partition).orderBy(F.col("_age").desc())
    return aged.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n).drop("_rn", "_age")


def _returning(aged: DataFrame, n: int, partition: Sequence[str], arrival: str) -> DataFrame:
    """Partitions where a key is put again after ``n`` or more newer keys."""
    event = lambda at, first: F.struct(F.col(at).alias("at"), F.lit(first).alias("first"))
    events = aged.filter(F.col(arrival) > F.col("_age")).count()
    if not events:
        return aged.select(*partition).limit(0)
    both = aged.select(*partition, F.col("_age").alias("_own"), F.explode(F.array(event("_age", 1), event(arrival, 0))).alias("e"))
    so_far = W.partitionBy(*partition).orderBy("e.at", F.col("e.first").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = both.withColumn("_seen", F.sum("e.first").over(so_far))
    span = counted.groupBy(*partition, "_own").agg((F.max("_seen") - F.min("_seen")).alias("_newer"))
    return span.filter(F.col("_newer") >= n).select(*partition).distinct()


def _replay(puts: DataFrame, n: int, partition: Sequence[str], keys: Sequence[str], arrival: str) -> DataFrame:
    schema, width = to_arrow_schema(puts.schema), len(partition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, store = None, {}

        def content() -> pa.RecordBatch:
            rows = [(*current, *key, at) for key, at in store.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:width] != current:
                    if store:
                        yield content()
                    current, store = row[:width], {}
                key = row[width:-1]
                if key not in store and len(store) == n:
                    del store[next(iter(store))]
                store[key] = row[-1]
        if store:
            yield content()

    ordered = puts.repartition(*partition).sortWithinPartitions(*partition, arrival)
    return ordered.mapInArrow(run, puts.schema)


def inherit_timestamps(
    rows: DataFrame, captured: DataFrame, keys: Sequence[str] = FRAME_KEYS, arrival: str = "arrival_seq"
) -> DataFrame:
    """Give every row its frame's immutable (source, ts_ns).

    The first captured value wins. A frame never captured keeps the first fallback
    its own rows brought, which then serves all of them.
    """
    fields = F.struct("source", "ts_ns")
    stored = captured.groupBy(*keys).agg(F.min_by(fields, arrival).alias("_stored"))
    brought = rows.groupBy(*keys).agg(F.min_by(fields, arrival).alias("_brought"))
    resolved = brought.join(stored, list(keys), "left").select(
        *keys, F.coalesce("_stored", "_brought").alias("_ts")
    )
    own = [c for c in rows.columns if c not in (*keys, "source", "ts_ns")]
    return rows.join(resolved, list(keys)).select(*keys, *own, "_ts.source", "_ts.ts_ns")


def join_payloads(
    metadata: DataFrame,
    payloads: DataFrame,
    keys: Sequence[str] = BUFFER_KEYS,
    arrival: str = "arrival_seq",
    require_metadata: bool = True,
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Match payloads to the metadata put under the same buffer key, one to one in arrival order.

    A payload takes the newest put since the key's previous payload; a put of its own arrival
    number counts as earlier. A NULL key never matches. With ``require_metadata=False`` unmatched
    payloads stay, without metadata.

    Keys are counted first (combined before the shuffle). Those with one put and one payload, as
    unique timestamps make them, take a plain join; repeated keys are read in order by windows, and
    keys of over ``hot_rows`` rows slice by slice.
    """
    keys = list(keys)
    known = F.col(keys[-1]).isNotNull()
    brought = [c for c in metadata.columns if c not in (*keys, arrival)]
    own = [c for c in payloads.columns if c not in keys]
    body = F.struct(F.col(arrival).alias("metadata_seq"), *brought)
    puts = metadata.filter(known).select(*keys, F.col(arrival).alias("_at"), F.lit(0).alias("_side"), body.alias("_put"))
    every = payloads.select(*keys, F.col(arrival).alias("_at"), F.lit(1).alias("_side"), F.struct(*own).alias("_payload"))
    sent = every.filter(known)

    sides = puts.select(*keys, "_side").unionByName(sent.select(*keys, "_side"))
    repeated = find_hot_keys(sides, [*keys, "_side"], 1)
    if not repeated.present:
        matched = _match_single(puts, sent, keys)
    else:
        # a key may stand here once per side
        again = broadcast_if(repeated.table.select(*keys), repeated.small)
        matched = _match_single(_by_key(puts, again, keys, "left_anti"), _by_key(sent, again, keys, "left_anti"), keys)
        both = _by_key(puts, again, keys, "left_semi").unionByName(
            _by_key(sent, again, keys, "left_semi"), allowMissingColumns=True
        )
        hot = find_hot_keys(both.select(*keys), keys, hot_rows)
        if hot.present:
            side = broadcast_if(hot.table, hot.small)
            matched = matched.unionByName(_match_sliced(_by_key(both, side, keys, "left_semi"), keys))
            both = _by_key(both, side, keys, "left_anti")
        matched = matched.unionByName(_match_in_order(both, keys).select(*keys, "_put", "_payload"))
    if require_metadata:
        return matched.filter(F.col("_put").isNotNull()).select(*keys, "_put.*", "_payload.*")
    loose = matched.unionByName(every.filter(~known).select(*keys, "_payload"), allowMissingColumns=True)
    return loose.select(*keys, "_put.*", "_payload.*")


def _by_key(df: DataFrame, side: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on equal keys, where NULL equals NULL; ``side`` has the keys and may have more."""
    other = side.withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]
    return df.join(other, same, how).drop(*[f"_key_{i}" for i in range(len(keys))])


def _match_single(puts: DataFrame, sent: DataFrame, keys: list[str]) -> DataFrame:
    """At most one put and one payload per key: the put counts if it did not come later."""
    both = _by_key(sent, puts.select(*keys, F.col("_at").alias("_put_at"), "_put"), keys, "left")
    return both.select(*keys, F.when(F.col("_put_at") <= F.col("_at"), F.col("_put")).alias("_put"), "_payload")


def _match_in_order(both: DataFrame, part: list[str]) -> DataFrame:
    """Payload rows with the newest put since the payload before, and how many payloads came before."""
    in_order = W.partitionBy(*part).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, -1)
    turns = both.withColumn("_turn", F.coalesce(F.sum("_side").over(in_order), F.lit(0)))
    since = W.partitionBy(*part, "_turn").orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    return turns.withColumn("_put", F.last("_put", ignorenulls=True).over(since)).filter("_side = 1")


def _match_sliced(both: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of any size. A slice hands on its last row if that is a put: no payload has taken it yet."""
    rows = ordered_slices(both, keys, [F.col("_at"), F.col("_side")])
    part = [*keys, "_segment"]
    last = rows.groupBy(*part).agg(F.max_by("_put", F.struct("_at", "_side")).alias("_open"))
    before = W.partitionBy(*keys).orderBy("_segment")
    handed = last.select(*part, F.lag("_open").over(before).alias("_handed"))
    joined = _by_key(_match_in_order(rows, part), handed, part, "inner")
    first = F.when(F.col("_turn") == 0, F.col("_handed"))
    return joined.select(*keys, F.coalesce("_put", first).alias("_put"), "_payload")


def latest_metadata(
    payloads: DataFrame,
    metadata: DataFrame,
    value: str,
    partition: Sequence[str] = ("stream_id", "stage"),
    arrival: str = "arrival_seq",
    width: int = BUCKET_ROWS,
) -> DataFrame:
    """Fallback for payloads without a match: ``value`` of the newest metadata put so far."""
    return bucketed_last_before(payloads, metadata, partition, arrival, value, width)


def fresh_frames(
    frames: DataFrame, assessed: DataFrame, keys: Sequence[str] = FRAME_KEYS
) -> DataFrame:
    """Frames with at least one object that yielded predictions."""
    return frames.join(assessed.select(*keys).distinct(), list(keys), "left_semi").select(*frames.columns)
