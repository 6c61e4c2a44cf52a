"""Token counts of a sentencepiece BPE vocabulary, without producing ids.

Method: rank-synchronous merging. A batch of pre-tokens is one flat symbol array with row
bounds; in every round each row applies its lowest-rank pair, all rows at once, and rows
without a pair leave. What survives is counted: a known symbol is one token, an unknown
character as many tokens as it has UTF-8 bytes (byte fallback). A few symbols can merge further before the
rank that made them; their occurrences in a row are applied one a round. Rows of over ``LONG``
symbols that hold many such occurrences would need as many rounds, so long rows go through a heap of
(rank, position) instead, merge by merge, with the same result.

Rows are independent because no piece has a space mark after another character (checked), so
a text may be cut before every space that follows a non-space.

Defined results: NULL counts as empty; an empty text has 0 tokens; special strings are
ordinary text; rows, repeated ones too, are counted one by one; columns are only added.
"""

import re
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WordCache, plain_name, text_of, vocabulary_path, windows, worker_state

SPACE = "▁"
NONE = np.int32(2**31 - 1)
LONG = 512  # symbols from which a row is merged by itself


def merge_table(pieces: list) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of pieces that join to a piece: sorted keys left * n + right, and the results."""
    at, n = {p: i for i, p in enumerate(pieces)}, len(pieces)
    found = [
        (at[p[:cut]] * n + at[p[cut:]], i)
        for i, p in enumerate(pieces)
        for cut in range(1, len(p))
        if p[:cut] in at and p[cut:] in at
    ]
    pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
    return np.ascontiguousarray(pairs[:, 0]), pairs[:, 1].astype(np.int32)


def order_sensitive(keys: np.ndarray, results: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Symbols that can take part in a merge ranked before the merge that made them. After such a
    merge the next choice may lie elsewhere, so its occurrences are applied one by one."""
    n = len(rank)
    out = np.zeros(n, bool)
    for side in (keys // n, keys % n):
        out[side[rank[results] < rank[side]]] = True
    return out


class PieceCounter:
    """Counts tokens; ``rank`` orders merges, -1 cost marks symbols outside the vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(" a  ﬁ ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}ﬁ{SPACE}":
            raise ValueError("only vocabularies with the identity normaliser and a leading space mark")
        special = lambda i: model.is_control(i) or model.is_byte(i) or model.is_unknown(i)
        scored = sorted((-model.get_score(i), model.id_to_piece(i)) for i in range(model.get_piece_size()) if not special(i))
        pieces = [p for _, p in scored]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece has a space mark inside")
        known = set(pieces)
        extra = sorted({c for p in pieces for c in p} - known)  # characters that are no piece themselves
        pieces += extra
        self.n = len(pieces)
        self.keys, self.results = merge_table(pieces)
        self.rank = np.arange(self.n, dtype=np.int32)
        made = np.array([len(p) > 1 for p in pieces])
        self.single_steps = order_sensitive(self.keys, self.results, np.where(made, self.rank, -1)) & made
        self.symbol = {p: i for i, p in enumerate(pieces) if len(p) == 1}
        self.outside = np.zeros(self.n, bool)
        self.outside[self.n - len(extra) :] = True
        self.extra_cost = {self.symbol[c]: len(c.encode()) for c in extra}
        alone = "\n" not in self.symbol
        self.cut = re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if alone else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.cache = WordCache()
        self.pairs = dict(zip(self.keys.tolist(), self.results.tolist()))

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank (= symbol) of the joined pair, NONE if there is none."""
        key = left.astype(np.int64) * self.n + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.results[at], NONE)

    def count_rows(self, rows: list[str]) -> np.ndarray:
        """Tokens of every row, a batch at a time."""
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        flat, inverse = np.unique(np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32), return_inverse=True)
        ids = np.array([self.symbol.get(chr(c), -1) for c in flat], np.int32)
        width = np.array([len(chr(c).encode()) for c in flat], np.int64)
        sym, owner = ids[inverse], np.repeat(np.arange(len(rows)), lengths)
        cost = np.where(sym < 0, width[inverse], 1)
        for symbol, bytes_ in self.extra_cost.items():
            cost[sym == symbol] = bytes_
        total = np.zeros(len(rows), np.int64)
        same = owner[1:] == owner[:-1]
        rank = np.full(len(sym), NONE, np.int32)
        rank[:-1][same] = self.lookup(sym[:-1][same], sym[1:][same])
        while len(sym):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[first, len(owner)])
            lowest = np.minimum.reduceat(rank, first)
            done = np.repeat(lowest == NONE, sizes)
            if done.any():
                total += np.bincount(owner[done], weights=cost[done], minlength=len(rows)).astype(np.int64)
                sym, owner, cost, rank = sym[~done], owner[~done], cost[~done], rank[~done]
                continue
            at = np.flatnonzero(rank == np.repeat(lowest, sizes))
            # overlapping occurrences ("aaa"): every second one of a run, from the left
            fresh = np.r_[True, np.diff(at) != 1]
            run = np.maximum.accumulate(np.where(fresh, at, 0))
            take = (at - run) % 2 == 0
            opening = np.r_[True, owner[at][1:] != owner[at][:-1]]
            take &= opening | ~self.single_steps[rank[at]]
            at = at[take]
            sym[at], cost[at] = rank[at], 1
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            changed = np.zeros(len(sym), bool)
            changed[at] = True
            keep = ~gone
            sym, owner, cost, rank, changed = sym[keep], owner[keep], cost[keep], rank[keep], changed[keep]
            changed[:-1] |= changed[1:]
            redo = np.flatnonzero(changed)
            after = np.minimum(redo + 1, len(sym) - 1)
            joined = (redo + 1 < len(sym)) & (owner[after] == owner[redo])
            rank[redo] = np.where(joined, self.lookup(sym[redo], sym[after]), NONE)
        return total

    def count_long(self, row: str) -> int:
        """Tokens of one long row, by a heap of its pairs."""
        n, pairs = len(row), self.pairs
        sym = [self.symbol.get(c, -1) for c in row]
        cost = [len(c.encode()) if s < 0 else self.extra_cost.get(c, 1) for c, s in zip(row, sym)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        current, heap = [-1] * n, []

        def look(i: int) -> None:
            j = after[i]
            found = pairs.get(sym[i] * self.n + sym[j]) if j < n and sym[i] >= 0 and sym[j] >= 0 else None
            current[i] = -1 if found is None else found
            if found is not None:
                heappush(heap, (found, i))

        for i in range(n):
            look(i)
        while heap:
            rank, i = heappop(heap)
            if current[i] != rank:
                continue
            gone = after[i]
            sym[i], cost[i], cost[gone], current[gone], after[i] = rank, 1, 0, -1, after[gone]
            if after[i] < n:
                before[after[i]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        return sum(cost)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts; pre-tokens seen before come from the cache."""
        out, held, size = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            # a written space mark is the same symbol as a space
            for k, piece in enumerate(windows(text.replace(SPACE, " ")) if text else ()):
                held.append((i, self.cut.findall((piece if k else " " + piece).replace(" ", SPACE))))
                size += len(piece)
                if size > 1 << 21:
                    self._add(held, out)
                    held, size = [], 0
        self._add(held, out)
        return out

    def _add(self, held: list, out: list[int]) -> None:
        cache = self.cache
        cache.trim()
        new = list(set().union(*(rows for _, rows in held)).difference(cache))
        passing = {}
        if new:
            passing.update((row, self.count_long(row)) for row in new if len(row) > LONG)
            new = [row for row in new if len(row) <= LONG]
            for row, n in zip(new, self.count_rows(new).tolist()):
                (cache if len(row) <= cache.longest else passing)[row] = n
        for i, rows in held:
            if passing:
                out[i] += sum(cache[r] if r in cache else passing[r] for r in rows)
            else:
                out[i] += sum(map(cache.__getitem__, rows))


def with_token_counts(
    df: DataFrame, model: str = "piece_bpe_32k.model", text: str = "text", out: str = "n_tokens"
) -> DataFrame:
    """``df`` with the number of tokens of every whole text, as the vocabulary's own library counts them."""

    @F.arrow_udf("long")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = worker_state(("pieces", model), lambda: PieceCounter(vocabulary_path(model)))
        for texts in batches:
            yield pa.array(counter.count(texts.to_pylist()), pa.int64())

    return df.withColumn(out, tokens(text_of(text)))


def token_report(docs: DataFrame, limit: int = 4096, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Per document: bytes, tokens, and whether it is over the context limit."""
    counted = with_token_counts(docs.select("doc_id", text_of("text").alias("text")), model)
    n = plain_name(counted, "over_limit")
    return counted.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias(n)
    )
