"""Packing of tokenised documents into sequences of a fixed size.

Method: first-fit decreasing with a tournament tree over the bins' free places, run independently in
randomised groups of pieces. A document is cut at every ``size`` ids; full pieces are sequences of
their own. The rest is dealt at random to groups of about ``GROUP_PIECES``; in a group the pieces go,
longest first, into the first bin with room, which the tree finds in one descent. A group knows
lengths only, never ids, so its memory is bounded whatever the documents are.

First-fit leaves a few bins of every group half empty. Their pieces are spread over all free places
of the group, cut where a place ends (``refill``); what is then left over forms one last run, cut
into powers of two, which need no padding.

Pieces are numbered by the task that wrote them, so equal documents, equal ids and NULL ids spread
like all others. The numbered pieces are a written table: a lost executor reads them again, and the
groups do not change.

Defined results: NULL and empty texts are one piece that holds the end id alone; repeated rows are
packed one by one; an empty table gives no pieces; other columns, whatever their names, are not read.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sightlake.session import materialize

from .cached_ids import WordIds
from .common import BATCH_BYTES, batch_of, text_of, vocabulary_path, worker_state

SIZE = 4096
GROUP_PIECES = 50_000
# bins filled less than this are dissolved and their pieces cut into the free places of the others
DISSOLVE = 0.97
LENGTHS = "piece long, length int, group int"
PLACES = "piece long, cut int, length int, sequence_id long, offset int"


class FreePlaces:
    """Tournament tree: each node holds the most free places of any bin below it."""

    def __init__(self, bins: int, size: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.most = [size] * (2 * self.leaves)

    def first_fit(self, length: int) -> int:
        """The first bin with room for ``length``, which it takes."""
        most, node = self.most, 1
        while node < self.leaves:
            node *= 2
            if most[node] < length:
                node += 1
        bin_ = node - self.leaves
        most[node] -= length
        while node > 1:
            node >>= 1
            new = max(most[2 * node], most[2 * node + 1])
            if most[node] == new:
                break
            most[node] = new
        return bin_

    def free(self, bin_: int) -> int:
        return self.most[self.leaves + bin_]


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of every piece, and the ids in each bin."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.zeros(len(lengths), np.int64)
    tree = FreePlaces(max(1, len(lengths)), size)
    for i, length in zip(order.tolist(), lengths[order].tolist()):
        bins[i] = tree.first_fit(length)
    return bins, np.bincount(bins, weights=lengths).astype(np.int64)


def powers(length: int) -> Iterator[int]:
    """The powers of two that make up ``length``, largest first."""
    for bit in range(length.bit_length() - 1, -1, -1):
        if length >> bit & 1:
            yield 1 << bit


def refill(lengths: np.ndarray, bins: np.ndarray, filled: np.ndarray, size: int) -> list[tuple[int, int, int, int, int]]:
    """(piece, cut, length, bin, offset) of all pieces: those of poorly filled bins are cut into the
    free places of the others, and the last run into powers of two."""
    weak = filled < DISSOLVE * size
    offset, out = np.zeros(len(filled), np.int64), []
    loose = []
    for i in np.lexsort((-lengths, bins)).tolist():
        b, n = int(bins[i]), int(lengths[i])
        if weak[b]:
            loose.append((i, n))
        else:
            out.append((i, 0, n, b, int(offset[b])))
            offset[b] += n
    # places to fill: gaps of the other bins, then new bins, the last of them as powers of two
    gaps = [(b, int(size - offset[b])) for b in np.flatnonzero(~weak & (filled < size)).tolist()]
    rest = max(0, sum(n for _, n in loose) - sum(room for _, room in gaps))
    names = iter(np.flatnonzero(weak).tolist())
    extra = len(filled)
    for room in [*[size] * (rest // size), *powers(rest % size)]:
        b = next(names, None)
        if b is None:
            b, extra = extra, extra + 1
        gaps.append((b, room))
    places = iter(gaps)
    b, room, at = 0, 0, 0
    for i, n in loose:
        cut = 0
        while cut < n:
            if not room:
                b, room = next(places)
                at = int(offset[b]) if b < len(offset) and not weak[b] else 0
            take = min(room, n - cut)
            out.append((i, cut, take, b, at))
            cut, at, room = cut + take, at + take, room - take
    return out


def pieces_of(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, size: int = SIZE,
              doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most ``size`` ids, written: piece (a number), doc_id, start, length, doc_tokens and
    ids (packed)."""
    kinds = [("piece", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]
    schema = pa.schema(kinds)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(("packing", tokenizer), lambda: WordIds(vocabulary_path(tokenizer)))
        number, end = TaskContext.get().partitionId() << 36, np.array([end_id], "<u4").tobytes()
        rows, held = [], 0
        for batch in batches:
            for doc, packed in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                packed += end
                n = len(packed) // 4
                for start in range(0, n, size):
                    part = packed[4 * start : 4 * (start + size)]
                    rows.append((number, doc, start, len(part) // 4, n, part))
                    number, held = number + 1, held + len(part)
                    if held > BATCH_BYTES:
                        yield batch_of(schema, list(zip(*rows)))
                        rows, held = [], 0
        if rows:
            yield batch_of(schema, list(zip(*rows)))

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return materialize(slim.mapInArrow(cut, "piece long, doc_id long, start long, length int, doc_tokens long, ids binary"), "pieces")


def placed(pieces: DataFrame, size: int = SIZE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Where every piece goes, written: piece, cut (ids of the piece before this part), length,
    sequence_id, offset. ``pieces`` has piece (unique) and length; it is read twice."""
    slim = pieces.select("piece", "length")
    short = slim.filter(F.col("length") < size)
    n_groups = max(1, math.ceil(short.count() / group_pieces))
    schema = pa.schema([("piece", pa.int64()), ("cut", pa.int32()), ("length", pa.int32()), ("sequence_id", pa.int64()), ("offset", pa.int32())])

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("piece")  # the order rows arrive in does not matter
        numbers = table.column("piece").to_numpy()
        lengths = table.column("length").to_numpy().astype(np.int64)
        rows = np.array(refill(lengths, *first_fit_decreasing(lengths, size), size), np.int64).reshape(-1, 5)
        names = (np.int64(key[0].as_py()) << 40 | rows[:, 3]) * 2 + 1
        return pa.table([numbers[rows[:, 0]], rows[:, 1].astype(np.int32), rows[:, 2].astype(np.int32), names, rows[:, 4].astype(np.int32)], schema=schema)

    group = F.pmod(F.xxhash64("piece"), F.lit(n_groups)).cast("int")
    packed = short.withColumn("group", group).groupBy("group").applyInArrow(pack, PLACES)
    whole = slim.filter(F.col("length") == size).select(
        "piece", F.lit(0).alias("cut"), "length", (F.col("piece") * 2).alias("sequence_id"), F.lit(0).alias("offset")
    )
    return materialize(packed.unionByName(whole), "places")


def packed(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """Every part of a piece with its ids: doc_id, start, length, doc_tokens, sequence_id, offset, ids."""
    part = F.expr("substring(ids, 4 * cut + 1, 4 * length)")
    return pieces.drop("length").join(places, "piece").select(
        "doc_id", (F.col("start") + F.col("cut")).alias("start"), F.col("length").cast("long").alias("length"), "doc_tokens",
        "sequence_id", F.col("offset").cast("long").alias("offset"), part.alias("ids"),
    )


def sequences(parts: DataFrame, size: int = SIZE, pad_id: int = 0) -> DataFrame:
    """The sequences themselves: sequence_id, ids (packed and padded), n_tokens, starts (where each
    part begins, for attention masks). A sequence gathers at most ``size`` ids, so its parts are few."""
    item = F.struct("offset", "ids")
    gathered = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("items", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    exact = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    pad = F.when(exact, 0).otherwise(size - F.col("n_tokens")).cast("int")
    filler = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), pad))
    return gathered.select("sequence_id", F.concat(joined, filler).alias("ids"), "n_tokens", F.col("items.offset").alias("starts"))


def packing_report(docs: DataFrame) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = pieces_of(docs)
    return packed(pieces, placed(pieces)).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
