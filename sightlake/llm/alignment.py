"""Alignment of two tokenizers' tokens of the same text: divide and conquer at shared cuts.

Method: both tokenizations are lists of byte offsets at which tokens end. An interval of tokens is
divided at a common end near its middle: the middle token's end is looked for among the other side's
ends by bisection, then its neighbours' left and right in growing blocks; both halves are divided
again. An interval without a common end inside is a leaf, a group of tokens. All intervals of a
level are searched at once.

Tokens never cross a single space between two other characters, in either tokenization, so such
places are common ends known beforehand: each piece of text between them is aligned once and kept in
a bounded memo, and a document is the sequence of its pieces.

Counts of id pairs over the corpus: documents are taken in blocks. A block asks for each of its
distinct pairs once, with the number of its documents that hold it; the sums over blocks are the
counts, and each block gets the answers for its own pairs. So the shuffle carries pairs of blocks, not
links of documents, and a pair that every document holds costs one row a block. Documents and
requests are a written table; lost executors read it again.

Defined results: texts that are NULL, empty, or whose joined token bytes differ from a space and the
text on either side have no tokens: zeros and an empty digest. Special strings are ordinary text.
Repeated rows and rows without id count as documents each. An empty table gives no rows.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from sightlake.session import new_path

from .cached_ids import LETTER, MARKS, ByteLevelIds
from .common import batch_of, vocabulary_path, windows, worker_state

SPACE = "▁"
BLOCK_CHARS = 1 << 22
NEAR = 16  # single ends tried around the middle before whole blocks of them


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in both lists of their common values, by division near the middle. Lists ascend and
    end with the same value."""
    na = len(ends_a)
    cut = np.zeros(na, bool)
    if not na:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    partner = np.full(na, -1, np.int64)
    cut[-1], partner[-1] = True, len(ends_b) - 1

    def common(at: np.ndarray) -> np.ndarray:
        found = np.searchsorted(ends_b, ends_a[at])
        hit = ends_b[np.minimum(found, len(ends_b) - 1)] == ends_a[at]
        partner[at[hit]] = found[hit]
        return hit

    lo, hi = np.array([0]), np.array([na - 1])  # candidates lo <= i < hi; token hi ends the interval
    while len(lo):
        middle = (lo + hi) // 2
        where = np.full(len(lo), -1, np.int64)
        open_ = np.arange(len(lo))
        for step in range(2 * NEAR):  # middle, middle + 1, middle - 1, middle + 2, ...
            at = middle[open_] + (step // 2 + step % 2 if step % 2 else -(step // 2))
            fits = (at >= lo[open_]) & (at < hi[open_])
            hit = np.zeros(len(open_), bool)
            hit[fits] = common(at[fits])
            where[open_[hit]] = at[hit]
            reach = step // 2 + 1
            more = ~hit & ((middle[open_] + reach < hi[open_]) | (middle[open_] - reach >= lo[open_]) | (step == 0))
            open_ = open_[more]
            if not len(open_):
                break
        for k in open_.tolist():  # long stretches without a common end nearby
            where[k] = _far(common, int(lo[k]), int(middle[k]), int(hi[k]))
        found = where >= 0
        at = where[found]
        cut[at] = True
        lo, hi = np.concatenate([lo[found], at + 1]), np.concatenate([at, hi[found]])
        wide = lo < hi
        lo, hi = lo[wide], hi[wide]
    at = np.flatnonzero(cut)
    return at, partner[at]


def _far(common, lo: int, middle: int, hi: int) -> int:
    """A common end in lo..hi-1 near the middle, looked for in blocks that double; -1 if none."""
    left, right, block = max(lo, middle - NEAR), min(hi, middle + NEAR + 1), 2 * NEAR
    while left > lo or right < hi:
        sides = [np.arange(max(lo, left - block), left)[::-1], np.arange(right, min(hi, right + block))]
        best = [int(side[hit[0]]) for side in sides if len(side) and len(hit := np.flatnonzero(common(side)))]
        if best:
            return min(best, key=lambda i: abs(i - middle))
        left, right, block = max(lo, left - block), min(hi, right + block), 2 * block
    return -1


def group_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct id pairs of one group as a << 32 | b, and how many occurrence pairs each stands for."""
    (ua, ca), (ub, cb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    return (ua[:, None] << 32 | ub[None, :]).ravel(), (ca[:, None] * cb[None, :]).ravel()


class Aligner:
    """Aligned pieces of text, memoised: numbers per piece in growing arrays."""

    def __init__(self, path_a: str, path_b: str, entries: int = 450_000):
        import sentencepiece

        self.a = ByteLevelIds(path_a, special_as_text=True)  # its own memo stays empty
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        vocabulary = sorted(self.a.tokenizer.get_vocab().items(), key=lambda x: x[1])
        back = {c: b for b, c in self.a.letters.items()}
        decoded = lambda t: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        self.bytes_a = [b""] * (vocabulary[-1][1] + 1)
        for token, i in vocabulary:
            self.bytes_a[i] = decoded(token)
        n = self.b.get_piece_size()
        self.bytes_b = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(SPACE, " ").encode()
            for i in range(n)
        ]
        inside = [self.b.id_to_piece(i) for i in range(n) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in inside):
            raise ValueError("a piece has a space mark or a line feed inside")
        self.width_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.width_b = np.array([len(t) for t in self.bytes_b], np.int64)
        if any(re.search(rf"{LETTER}[{MARKS}]", p) for p in inside):
            raise ValueError("a piece has a mark after a letter")
        self.names = list(map(str, range(max(n, len(self.bytes_a)))))
        self.entries = entries
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.strings: list[str] = []
        self.numbers = np.zeros((1025, 4), np.int64)  # tokens a, tokens b, groups, links; -1: bytes differ
        self.first = np.zeros(1025, np.int64)  # of each piece's pairs
        self.pairs, self.times = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _append(self, strings: list[str], numbers: np.ndarray, sizes: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> None:
        n, m = len(self.strings), len(strings)
        while n + m + 1 > len(self.first):
            self.numbers, self.first = np.concatenate([self.numbers, np.zeros_like(self.numbers)]), np.concatenate([self.first, np.zeros_like(self.first)])
        used = int(self.first[n])
        while used + len(pairs) > len(self.pairs):
            self.pairs, self.times = np.concatenate([self.pairs, np.zeros_like(self.pairs)]), np.concatenate([self.times, np.zeros_like(self.times)])
        self.numbers[n : n + m] = numbers
        self.first[n + 1 : n + m + 1] = used + np.cumsum(sizes)
        self.pairs[used : used + len(pairs)], self.times[used : used + len(pairs)] = pairs, times
        self.strings += strings

    def cut(self, window: str) -> list[str]:
        """Pieces that start at a common end: a space or line feed, or a single mark after a word."""
        if "\0" in window:
            return [window]
        # a window starts with a space; where that is cut off, nothing stands before it
        return self.a.marked(window).removeprefix("\0").split("\0")

    def _tokens_b(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """B's ids of pieces and how many each has, -1 where bytes differ. Words are encoded together and
        cut apart by bytes, other pieces one by one after a word."""
        counts, found = np.full(len(pieces), -1, np.int64), {}
        words = [k for k, p in enumerate(pieces) if p[0] == " " and not p[-1].isspace()]
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            text = "".join([pieces[k] for k in part])
            ids = self.b.encode(text[1:], num_threads=1)
            ends = np.cumsum(self.width_b[ids])
            stops = np.cumsum([len(pieces[k].encode()) for k in part])
            at = np.minimum(np.searchsorted(ends, stops), len(ends) - 1)
            if b"".join(map(self.bytes_b.__getitem__, ids)) == text.encode() and (ends[at] == stops).all():
                counts[part] = np.diff(at, prepend=-1)
                found[part[0]] = (part, np.array(ids, np.int64))
        for k in np.flatnonzero(counts < 0).tolist():
            p = pieces[k]
            ids = self.b.encode(p[1:] if p[0] == " " else "x" + p, num_threads=1)
            if p[0] != " ":  # what follows a word keeps to itself
                if self.bytes_b[ids[0]] != b" x":
                    continue
                ids = ids[1:]
            if b"".join(map(self.bytes_b.__getitem__, ids)) == p.encode():
                counts[k] = len(ids)
                found[k] = ([k], np.array(ids, np.int64))
        first = np.cumsum(np.maximum(counts, 0)) - np.maximum(counts, 0)
        out = np.zeros(int(np.maximum(counts, 0).sum()), np.int64)
        for part, ids in found.values():
            n = counts[part]
            out[np.repeat(first[part] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, counts

    def learn(self, pieces: list[str]) -> None:
        """Align new pieces; all of them are one run of tokens, divided at common ends."""
        b, n_b = self._tokens_b(pieces)
        found = self.a.learn(pieces)
        raw = list(map(found.__getitem__, pieces))
        a = np.frombuffer(b"".join(raw), "<u4").astype(np.int64)
        n_a = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        good = n_b >= 0
        last = np.cumsum(n_a)
        sizes = np.array([len(p.encode()) for p in pieces], np.int64)
        same = b"".join(map(self.bytes_a.__getitem__, a.tolist())) == "".join(pieces).encode()
        if not same or (np.cumsum(self.width_a[a])[last - 1] != np.cumsum(sizes)).any():
            good &= [b"".join(map(self.bytes_a.__getitem__, a[y - n : y].tolist())) == p.encode() for n, y, p in zip(n_a.tolist(), last.tolist(), pieces)]
            a_kept, b_kept = np.repeat(good, n_a), np.repeat(good, np.maximum(n_b, 0))
        else:
            a_kept, b_kept = np.repeat(good, n_a), slice(None)
        kept = np.flatnonzero(good)
        numbers = np.full((len(pieces), 4), -1, np.int64)
        strings, sized = [""] * len(pieces), np.zeros(len(pieces), np.int64)
        pairs = times = np.zeros(0, np.int64)
        if len(kept):
            a, b = a[a_kept], b[b_kept]
            at_a, at_b = shared_cuts(np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b]))
            from_a, from_b = np.r_[0, at_a[:-1] + 1], np.r_[0, at_b[:-1] + 1]
            size_a, size_b = at_a + 1 - from_a, at_b + 1 - from_b
            owner = np.searchsorted(np.cumsum(n_a[kept]), from_a, side="right")  # piece of each group
            groups = np.bincount(owner, minlength=len(kept))
            stop = np.cumsum(groups)
            shown = self._shown(a, b, from_a, from_b, size_a, size_b)
            for k, x, y in zip(kept.tolist(), (stop - groups).tolist(), stop.tolist()):
                strings[k] = ";".join(shown[x:y])
            links = np.bincount(owner, weights=size_a * size_b, minlength=len(kept)).astype(np.int64)
            numbers[kept] = np.stack([n_a[kept], n_b[kept], groups, links], axis=1)
            sized[kept], pairs, times = self._pairs(a, b, from_a, from_b, size_a, size_b, owner, len(kept))
        start = len(self.strings)
        self._append(strings, numbers, sized, pairs, times)
        self.index.update(zip(pieces, range(start, start + len(pieces))))

    def _shown(self, a, b, from_a, from_b, size_a, size_b) -> list[str]:
        """Groups as text, `a1,a2|b1`."""
        name = self.names.__getitem__
        shown = [f"{x}|{y}" for x, y in zip(map(name, a[from_a].tolist()), map(name, b[from_b].tolist()))]
        for g in np.flatnonzero((size_a > 1) | (size_b > 1)).tolist():
            x, y = int(from_a[g]), int(from_b[g])
            shown[g] = f"{','.join(map(name, a[x : x + size_a[g]].tolist()))}|{','.join(map(name, b[y : y + size_b[g]].tolist()))}"
        return shown

    @staticmethod
    def _pairs(a, b, from_a, from_b, size_a, size_b, owner, n):
        """Id pairs of all groups in the order of their pieces: how many each piece has, keys, times."""
        area = size_a * size_b
        small = area <= 4096
        count = np.where(small, area, 0)
        which = np.repeat(np.arange(len(area)), count)
        rank = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        keys = a[from_a[which] + rank // size_b[which]] << 32 | b[from_b[which] + rank % size_b[which]]
        belongs, times = owner[which], np.ones(len(which), np.int64)
        for g in np.flatnonzero(~small).tolist():  # a long run without a common end
            k, t = group_links(a[from_a[g] : from_a[g] + size_a[g]], b[from_b[g] : from_b[g] + size_b[g]])
            keys, times, belongs = np.r_[keys, k], np.r_[times, t], np.r_[belongs, np.full(len(k), owner[g])]
        order = np.argsort(belongs, kind="stable")
        return np.bincount(belongs, minlength=n), keys[order], times[order]

    def pieces(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Each text's pieces as numbers of the memo; new pieces of many texts are learnt together."""
        held, size = [], 0

        def settle() -> Iterator[np.ndarray]:
            new = {p for parts in held for p in parts if p not in self.index}
            if new:
                self.learn(list(new))
            for parts in held:
                yield np.fromiter(map(self.index.__getitem__, parts), np.int64, len(parts))

        for text in texts:
            held.append([p for window in windows(" " + text) for p in self.cut(window)])
            size += len(text)
            if size > 1 << 21:
                yield from settle()
                held, size = [], 0
        yield from settle()

    def documents(self, texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, str]]:
        """Of each text: numbers (tokens a and b, groups, links), distinct pairs, their times, the
        groups as text."""
        usable = [bool(t) and SPACE not in t for t in texts]
        pieces = self.pieces([t for t, ok in zip(texts, usable) if ok])
        for ok in usable:
            yield self._document(next(pieces) if ok else None)

    def _document(self, at: np.ndarray | None) -> tuple[list[int], np.ndarray, np.ndarray, str]:
        nothing = [0] * 4, np.zeros(0, np.int64), np.zeros(0, np.int64), ""
        if at is None:
            return nothing
        numbers = self.numbers[at]
        if numbers.min() < 0:
            return nothing
        held, seen = np.unique(at, return_counts=True)
        sizes = self.first[held + 1] - self.first[held]
        rank = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        where = np.repeat(self.first[held], sizes) + rank
        pairs, inverse = np.unique(self.pairs[where], return_inverse=True)
        times = np.bincount(inverse, weights=self.times[where] * np.repeat(seen, sizes)).astype(np.int64)
        return numbers.sum(axis=0).tolist(), pairs, times, ";".join(map(self.strings.__getitem__, at.tolist()))


# of a document: its block and its pairs as places in the block's sorted pairs; of a request: block,
# place, pair, documents of the block that hold it
ROW = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
       "places binary, times binary, place int, pair long, docs long")
ROW_KINDS = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]
REPORT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
REPORT_KINDS = [pa.int64()] * 7 + [pa.string()]


def _schema(ddl: str, kinds: list[pa.DataType]) -> pa.Schema:
    return pa.schema([(c.split()[0], kind) for c, kind in zip(ddl.split(", "), kinds)])


def _aligner(a: str, b: str) -> Aligner:
    return worker_state(("alignment", a, b), lambda: Aligner(vocabulary_path(a), vocabulary_path(b)))


def with_groups(df: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", text: str = "text", out: str = "groups") -> DataFrame:
    """``df`` with the groups of every text, as `a1,a2|b1;a3|b2,b3` (ids in order; '' without tokens)."""

    @F.arrow_udf("string")
    def align(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        aligner = _aligner(a, b)
        for texts in batches:
            yield pa.array([found[3] for found in aligner.documents(texts.to_pylist())], pa.string())
            if len(aligner.index) > aligner.entries:
                aligner.clear()

    return df.withColumn(out, align(F.col(text)))


def aligned_blocks(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents and requests of all blocks (``ROW``), written."""
    schema = _schema(ROW, ROW_KINDS)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block = _aligner(a, b), TaskContext.get().partitionId() << 32
        rows, held, size = [], [], 0

        def settle() -> Iterator[pa.RecordBatch]:
            pairs, place, docs_ = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
            start, n = 0, len(rows)
            for row, own in zip(rows, held):
                row[7] = np.diff(place[start : start + len(own)], prepend=0).astype("<i4").tobytes()
                start += len(own)
            yield batch_of(schema, [*zip(*rows)] + [[None] * n] * 3)
            for i in range(0, len(pairs), 50_000):
                part = pairs[i : i + 50_000]
                m = len(part)
                yield batch_of(schema, [[block] * m] + [[None] * m] * 8 + [range(i, i + m), part, docs_[i : i + m]])

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for doc, text, found in zip(batch.column(0).to_pylist(), texts, aligner.documents(texts)):
                numbers, pairs, times, shown = found
                digest = hashlib.sha256(shown.encode()).hexdigest() if shown else ""
                rows.append([block, doc, *numbers, digest, b"", times.astype("<i4").tobytes()])
                held.append(pairs)
                size += len(text or "")
                if size > block_chars or len(rows) > 20_000:
                    yield from settle()
                    rows, held, size, block = [], [], 0, block + 1
            if len(aligner.index) > aligner.entries:
                aligner.clear()
        if rows:
            yield from settle()

    spark = docs.sparkSession
    path = new_path(spark, "alignment")
    blocks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(align, ROW)
    blocks.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(blocks.schema).parquet(path)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """Per linked id pair: pair (a << 32 | b), n (documents that hold it), best (the highest of its a)."""
    counts = blocks.filter("pair is not null").groupBy("pair").agg(F.sum("docs").alias("n"))
    of_a = Window.partitionBy(F.shiftright("pair", 32))  # at most as many rows as B has ids
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_a))


def alignment_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    blocks = aligned_blocks(docs)
    asked = blocks.filter("pair is not null").select(F.col("block").alias("asked_by"), "place", "pair")
    answers = asked.join(pair_counts(blocks), "pair").select("asked_by", "place", "n", "best")
    schema = _schema(REPORT, REPORT_KINDS)

    def add_up(documents: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(answers.column("place").to_numpy())
        n, best = answers.column("n").to_numpy()[order], answers.column("best").to_numpy()[order]
        out = []
        for row in documents.to_pylist():
            at = np.cumsum(np.frombuffer(row["places"], "<i4"))
            times = np.frombuffer(row["times"], "<i4").astype(np.int64)
            out.append([
                row["doc_id"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"],
                int(times[best[at]].sum()), int((times * n[at]).sum()), row["groups_sha256"],
            ])
        columns = [*zip(*out)] if out else [[]] * len(schema)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    documents = blocks.filter("pair is null").select(*[c.split()[0] for c in ROW.split(", ")[:9]])
    return documents.groupBy("block").cogroup(answers.groupBy("asked_by")).applyInArrow(add_up, REPORT)
