"""Exact deduplication of whole texts with DataFrame functions only.

Method: an extendible-hash index in the shared folder. Every row gives one entry (64-bit key of
its normalised text, id, digest). The directory is grown by doubling: a bucket above its
capacity splits by the next bits of the key, as long as it holds more than one key. Entries are
written in bucket and key order, so a file holds a range of keys; a chain of equal keys longer
than a bucket just runs on into the next files. Keys with several entries are chained: their
texts are fetched and grouped by key and by their bytes, so colliding keys stay apart.

Groups are counted by aggregates with map-side combine: a group of copies of any size sends one
row per task. Texts of rows whose key occurs once are never shuffled.

Defined results: NULL text counts as empty; white space runs count as one space; among equal
texts the smallest id stays, a NULL id only if there is no other; of rows with the same id and
text one stays. Every row, repeated ones too, has its row in the result.
"""

from pyspark.sql import Column, DataFrame, functions as F

from sightlake.session import materialize
from sightlake.skew import broadcast_if_small

from .common import BROADCAST_ROWS, plain_name, text_of

# runs of space, tab, line feed, vertical tab, form feed, carriage return; a single space needs no change
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
STEP_BITS = 16


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_of(text), RUNS, " ")


def directory(entries: DataFrame, capacity: int) -> list[DataFrame]:
    """Directory levels of 16 bits each: (cell, depth, bucket). ``depth`` is the fewest leading bits
    that make the cell's bucket hold at most ``capacity`` entries. Cells that are still too full
    after 16 bits and hold several keys continue in the next level."""
    levels, rest = [], entries.select("key")
    for base in range(0, 64, STEP_BITS):
        shift = 64 - base - STEP_BITS
        cells = rest.groupBy(F.shiftrightunsigned("key", shift).alias("cell")).agg(
            F.count("*").alias("n"), (F.min("key") < F.max("key")).alias("several")
        )
        cells = materialize(cells, "cells")
        doubled = (
            cells.select("n", F.explode(F.sequence(F.lit(1 if base else 0), F.lit(STEP_BITS))).alias("d"), "cell")
            .groupBy("d", F.expr(f"shiftrightunsigned(cell, {STEP_BITS} - d)").alias("prefix")).agg(F.sum("n").alias("in_bucket"))
        )
        fits = (
            cells.select("cell", F.explode(F.sequence(F.lit(1 if base else 0), F.lit(STEP_BITS))).alias("d"))
            .withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {STEP_BITS} - d)"))
            .join(broadcast_if_small(doubled, 2 << STEP_BITS), ["d", "prefix"])
            .filter((F.col("in_bucket") <= capacity) | (F.col("d") == STEP_BITS))
            .groupBy("cell").agg(F.min("d").alias("d"))
            .select("cell", (F.col("d") + base).alias("depth"), F.expr(f"shiftleft(shiftrightunsigned(cell, {STEP_BITS} - d), {shift} + {STEP_BITS} - d)").alias("bucket"))
        )
        full = cells.filter((F.col("n") > capacity) & F.col("several")).select("cell")
        more = base + STEP_BITS < 64 and not full.isEmpty()
        levels.append(materialize(fits.join(full, "cell", "left_anti") if more else fits, "directory"))
        if not more:
            break
        rest = materialize(
            rest.withColumn("cell", F.shiftrightunsigned("key", shift)).join(broadcast_if_small(full), "cell", "left_semi").select("key"),
            "overfull",
        )
    return levels


def write_index(docs: DataFrame, doc_id: str, text: str, capacity: int, key=F.xxhash64) -> DataFrame:
    """Index of ``docs`` in the shared folder: bucket, depth, key, row_no, id, sha; in key order."""
    norm = docs.select(F.col(doc_id).alias("id"), normalised(text).alias("norm"))
    entries = materialize(
        norm.select(
            "id", F.monotonically_increasing_id().alias("row_no"), key("norm").alias("key"), F.unhex(F.sha2("norm", 256)).alias("sha")
        ),
        "entries",
    )
    placed, rest = None, entries
    for level, cells in enumerate(directory(entries, capacity)):
        cell = F.shiftrightunsigned("key", 64 - STEP_BITS * (level + 1))
        joined = rest.withColumn("cell", cell).join(broadcast_if_small(cells, 1 << STEP_BITS), "cell", "left").drop("cell")
        found = joined.filter(F.col("depth").isNotNull())
        placed = found if placed is None else placed.unionByName(found)
        rest = joined.filter(F.col("depth").isNull()).drop("depth", "bucket")
    # signed order of the flipped bucket is the unsigned order of its key range
    owner = F.col("bucket").bitwiseXOR(F.lit(-(2**63)))
    ordered = placed.repartitionByRange(owner, F.col("key"), F.col("row_no")).sortWithinPartitions(owner, "key", "row_no")
    return materialize(ordered, "hash-index")


def duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 65_536, key=F.xxhash64
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    index = write_index(docs, doc_id, text, capacity, key)
    shared = index.groupBy("bucket", "key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    chained = materialize(index.join(shared, "key", "left_semi"), "chained")
    fetch = broadcast_if_small(chained.select(F.col("id").alias("_id")).distinct(), BROADCAST_ROWS)
    texts = (
        docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
        .join(fetch, F.col("id").eqNullSafe(F.col("_id")), "left_semi")
        .select("id", normalised("t").alias("norm"))
        .withColumn("key", key("norm"))
    )
    # the comparison of bytes: equal keys with different texts become links of their own
    chains = texts.groupBy("key", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    chains = chains.select("key", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    # of rows with the same id and text one stays
    rows = chained.groupBy("key", "sha").agg(F.min_by("row_no", "id").alias("with_id"), F.min("row_no").alias("without"))
    rows = rows.select("key", "sha", F.coalesce("with_id", "without").alias("stays"))
    groups = materialize(chains.join(rows, ["key", "sha"]), "chains")
    return index.join(groups, ["key", "sha"], "left").select(
        F.col("id").alias("doc_id"),
        F.when(F.col("stays").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("stays") == F.col("row_no"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns stay.

    A row is known by its id and text; of rows that repeat both, one stays.
    """
    found = materialize(duplicates(docs, doc_id, text), "duplicates")
    one, two = plain_name(docs, "_id"), plain_name(docs, "_sha")
    lost = found.filter(~F.col("kept"))
    out = docs.withColumn(two, F.sha2(normalised(text), 256))
    gone = lost.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias(one), F.col("text_sha256").alias("_gone"))
    out = out.join(
        broadcast_if_small(gone, BROADCAST_ROWS // 4),
        F.col(doc_id).eqNullSafe(F.col(one)) & (F.col(two) == F.col("_gone")), "left_anti",
    )
    repeated = lost.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id").distinct()
    if not repeated.isEmpty():
        again = F.col(doc_id).eqNullSafe(F.col("_again"))
        side = repeated.select(F.col("doc_id").alias("_again"))
        out = out.join(side, again, "left_anti").unionByName(
            out.join(side, again, "left_semi").dropDuplicates([doc_id, two])
        )
    return out.drop(two)
