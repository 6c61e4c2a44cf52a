"""SimHash near-duplicates of whole texts: all links at 3 or fewer differing bits.

Fingerprint: texts with A-Z lower-cased, words between white space, shingles of three words with
repeats (fewer words: the whole sequence; none: zero), XXH64 with seed 42, a bit for every
majority.

Method: meet in the middle. Two fingerprints at distance 3 or less share a variant within two
flips of one and one flip of the other. Choosing variants of even parity halves the work: a
fingerprint of even parity emits itself and its variants at two flips, one of odd parity its
variants at one flip; every pair within 3 then meets at such a variant, or at the even
fingerprint of the pair itself.

Variants are shuffled as prefixes: a fingerprint sends one row for each 12-bit prefix that its
variants have (79 or 13 instead of 2017 or 64), and the task that gets a prefix expands the
rest. Prefixes with more rows than ``limit`` are extended by 12 more bits, again and again, so no
task gets an unbounded group; equal fingerprints are collapsed before.

A variant met by its own (even) fingerprint, or by an odd one, links everything that meets there
to that hub: two and one flips are three at most. Where only even fingerprints at two flips meet,
they are linked elsewhere if they are close. So each meeting place gives a star instead of all
pairs, every link is verified by its distance, and no link between components is lost.

Components: minimum labels over alternating large and small stars on the distinct fingerprints,
each round a written table.

Defined results: NULL text counts as empty (fingerprint zero, linked like any other); the
component is the smallest reachable id, NULL ids apart; every row is reported; ties and repeated
rows share their component.
"""

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sightlake.session import materialize
from sightlake.skew import broadcast_if_small

from .common import BROADCAST_ROWS, batch_of, plain_name, text_of

SEED = 42
WORDS = 3
STEP_BITS = 12
GROUP_ROWS = 50_000
BLOCK = 1 << 20  # variants held at once


def simhash(data: bytes, words: int = WORDS) -> int:
    """Fingerprint of a UTF-8 text."""
    import xxhash

    parts = data.lower().split()  # bytes: only A-Z and the six ASCII spaces
    if not parts:
        return 0
    shingles = [b" ".join(parts)] if len(parts) < words else map(b" ".join, zip(*(parts[i:] for i in range(words))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp", words: int = WORDS) -> DataFrame:
    """``df`` with the 64-bit fingerprint of each whole text as a signed long."""

    @F.arrow_udf("long")
    def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            prints = np.fromiter((simhash(t, words) for t in texts.to_pylist()), np.uint64, len(texts))
            yield pa.array(prints.view(np.int64))

    return df.withColumn(out, fingerprint(text_of(text).cast("binary")))


def _flips(bits: int) -> Column:
    """Array of (mask, flips) with at most two of the lowest ``bits`` flipped."""
    masks = [(sum(1 << b for b in picked), k) for k in range(3) for picked in combinations(range(bits), k)]
    return F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(k).alias("used")) for m, k in masks])


def variant_prefixes(prints: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """Rows (fp, bits, prefix, used): where variants of each fingerprint are to meet.

    ``used`` flips lie in the first ``bits`` bits; the even ones have none or two in all, the odd
    ones exactly one. Crowded prefixes are extended until they hold at most ``limit`` rows or all
    64 bits are fixed (then one fingerprint's rows meet only variants equal to its own).
    """
    odd = F.bit_count("fp") % 2 == 1
    open_ = prints.select("fp", F.lit(0).cast("long").alias("prefix"), F.lit(0).alias("used"))
    out, bits = None, 0
    while True:
        step = min(STEP_BITS, 64 - bits)
        bits += step
        rows = (
            open_.withColumn("flip", F.explode(_flips(step)))
            .select(
                "fp",
                F.shiftleft("prefix", step).bitwiseOR(
                    F.shiftrightunsigned("fp", 64 - bits).bitwiseAND(F.lit((1 << step) - 1)).bitwiseXOR(F.col("flip.mask"))
                ).alias("prefix"),
                (F.col("used") + F.col("flip.used")).alias("used"),
            )
            .filter(F.col("used") <= F.when(odd, 1).otherwise(2))
        )
        if bits == 64:  # only whole variants are left
            rows = rows.filter(F.col("used") % 2 == F.bit_count("fp") % 2)
        closed = rows.withColumn("bits", F.lit(bits))
        crowded = rows.groupBy("prefix").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("prefix")
        crowded = None if bits == 64 else materialize(crowded, "crowded")
        if crowded is None or crowded.isEmpty():
            return closed if out is None else out.unionByName(closed)
        side = broadcast_if_small(crowded, BROADCAST_ROWS)
        done = closed.join(side, "prefix", "left_anti")
        out = done if out is None else out.unionByName(done)
        open_ = materialize(rows.join(side, "prefix", "left_semi").select("fp", "prefix", "used"), "prefixes")


def _masks(free: int) -> dict[int, np.ndarray]:
    one = np.array([1 << b for b in range(free)], np.uint64)
    two = np.array([(1 << a) | (1 << b) for a, b in combinations(range(free), 2)], np.uint64)
    return {0: np.zeros(1, np.uint64), 1: one, 2: two}


def meet(fp: np.ndarray, prefix: np.ndarray, used: np.ndarray, bits: int) -> np.ndarray:
    """Verified links (hub, member) of fingerprints that meet at a variant with the same prefix.
    Whole groups of a prefix must be passed together."""
    free = 64 - bits
    masks = _masks(free)
    fp, prefix = fp.astype(np.uint64), prefix.astype(np.uint64)
    low = np.uint64((1 << free) - 1)
    base = (prefix << np.uint64(free)) | (fp & low) if free else prefix
    odd = np.bitwise_count(fp) % 2 == 1

    def expand(rows: np.ndarray, flips: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        picked = masks[flips]
        if not len(picked):
            return
        size = max(1, BLOCK // len(picked))
        for i in range(0, len(rows), size):
            part = rows[i : i + size]
            yield (base[part][:, None] ^ picked).ravel(), np.repeat(fp[part], len(picked))

    def collect(parts) -> tuple[np.ndarray, np.ndarray]:
        parts = list(parts)
        none = np.zeros(0, np.uint64)
        return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (none, none)

    # hubs: odd fingerprints one flip away, even ones at the variant itself
    one_odd, none_odd = np.flatnonzero(odd & (used == 1)), np.flatnonzero(odd & (used == 0))
    centre = np.flatnonzero(~odd & (used == 0))
    places, hubs = collect([*expand(one_odd, 0), *expand(none_odd, 1), *expand(centre, 0)])
    if not len(places):
        return np.zeros((0, 2), np.uint64)
    order = np.lexsort((hubs, places))
    places, hubs = places[order], hubs[order]
    first = np.r_[True, places[1:] != places[:-1]]
    at, leader = places[first], hubs[first]
    links = [np.stack([leader[np.cumsum(first) - 1], hubs], 1)[~first]]
    filter_bits = max(10, int(len(at)).bit_length() + 3)
    spread, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - filter_bits)
    known = np.zeros(1 << filter_bits, bool)
    known[(at * spread) >> shift] = True
    for flips in range(3):  # even fingerprints at two flips in all
        for variants, owners in expand(np.flatnonzero(~odd & (used == 2 - flips)), flips):
            maybe = known[(variants * spread) >> shift]
            variants, owners = variants[maybe], owners[maybe]
            where = np.minimum(np.searchsorted(at, variants), len(at) - 1)
            hit = at[where] == variants
            links.append(np.unique(np.stack([leader[where[hit]], owners[hit]], 1), axis=0))
    pairs = np.unique(np.sort(np.concatenate(links), axis=1), axis=0)
    near = np.bitwise_count(pairs[:, 0] ^ pairs[:, 1])
    return pairs[(near > 0) & (near <= 3)]


def links(prints: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b), a < b as signed longs, that connect all fingerprints within distance 3."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            bits, prefix, fp, used = (np.concatenate([r[i] for r in rows]) for i in range(4))
            for width in np.unique(bits).tolist():
                own = bits == width
                pairs = np.sort(meet(fp[own].view(np.uint64), prefix[own].view(np.uint64), used[own], width).view(np.int64), axis=1)
                for i in range(0, len(pairs), 1 << 16):
                    yield batch_of(schema, [pairs[i : i + (1 << 16), 0], pairs[i : i + (1 << 16), 1]])

        n = 0
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            bits, prefix = columns[0], columns[1]
            # rows of the last prefix stay for the next batch
            open_at = len(bits)
            while n + open_at and open_at and bits[open_at - 1] == bits[-1] and prefix[open_at - 1] == prefix[-1]:
                open_at -= 1
            whole = open_at > 0 or (held and (held[-1][0][-1], held[-1][1][-1]) != (bits[0], prefix[0]))
            if whole and n + open_at >= limit:
                rows = [*held, tuple(c[:open_at] for c in columns)]
                yield from settle(rows)
                held, n = [tuple(c[open_at:] for c in columns)], len(bits) - open_at
            else:
                held.append(tuple(columns))
                n += len(bits)
        if n:
            yield from settle(held)

    rows = variant_prefixes(prints, limit).select("bits", "prefix", "fp", F.col("used").cast("int"))
    grouped = rows.repartition("bits", "prefix").sortWithinPartitions("bits", "prefix")
    return grouped.mapInArrow(collide, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component.

    Each round is a large star (every neighbour above a node goes to the node's smallest one) and a
    small star (those below do). Each keeps components together and makes labels smaller; rounds
    grow with the logarithm of the longest path. A node's neighbours are never gathered: minima are
    aggregates, and the joins with them are split by adaptive execution where a hub is skewed.
    """

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    def both(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        way = both(pairs) if large else pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        joined = way.join(smallest(way), "u")
        moved = joined.filter(F.col("v") > F.col("u")).select("v", "m") if large else (
            joined.select("v", "m").unionByName(joined.select(F.col("u").alias("v"), "m"))
        )
        return moved.filter("v != m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()

    current = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        moved = materialize(star(star(current, True), False), "edges")
        # done when every node has one edge, to a node that is no other's member
        open_ = moved.groupBy("b").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() or (
            moved.select("a").distinct().join(moved.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count()
        )
        current = moved
        if not open_:
            break
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        current.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = GROUP_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    prints = materialize(
        with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fp"), "fingerprints"
    )
    smallest = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = materialize(components(links(smallest.select("fp"), limit)), "roots")
    labelled = smallest.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    label = labelled.join(ids, "root").select("fp", "component_id")
    return prints.join(label, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest id stays.

    Rows that repeat a kept id stay too, as do rows without id: they cannot be told apart."""
    found = near_duplicates(docs, doc_id, text)
    lost = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_lost")).distinct()
    lost = broadcast_if_small(materialize(lost, "near-duplicates"), BROADCAST_ROWS)
    return docs.join(lost, F.col(doc_id) == F.col("_lost"), "left_anti")
