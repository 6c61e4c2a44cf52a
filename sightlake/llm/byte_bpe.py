"""Byte-level BPE by the ranks of a public vocabulary file, and decoding.

Method: a rank queue with a hierarchical bitmap. Each merge rank has a bucket of linked-list
positions; three levels of 64-bit words tell which buckets are filled, so find-first-set gives
the lowest rank in constant time. Merging relinks two neighbours; entries whose pair has
changed since are skipped when they are popped. Pre-tokens do not touch each other, so one queue
serves a batch of short ones, and the entries of a rank are merged together. A long pre-token has
the queue for itself: its buckets are heaps, and one merge costs the logarithm of a bucket. A text is cut before single spaces that follow a
non-space, where no match can cross, so that frequent words come from a bounded cache.

Defined results: NULL counts as empty; an empty text has no ids; special strings are ordinary
text; decoding gives back the text's UTF-8 bytes; rows and other columns stay as they are.
"""

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WordCache, text_of, vocabulary_path, windows, worker_state

LONG = 512  # bytes from which a pre-token is merged by itself


class RankQueue:
    """Buckets of positions per rank under a three-level bitmap."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: list[list] = [[] for _ in range(ranks)]

    def push(self, rank: int, positions) -> None:
        """``positions`` is one position or an array of them."""
        bucket = self.buckets[rank]
        if not bucket:
            word = rank >> 6
            self.low[word] |= 1 << (rank & 63)
            self.mid[word >> 6] |= 1 << (word & 63)
            self.top |= 1 << (word >> 6)
        bucket.append(positions)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, start, stop in zip(ranks[np.r_[0, cuts]].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(ranks)]):
            self.push(rank, positions[start:stop])

    def lowest(self) -> int:
        """The lowest filled rank, found by the first set bit of each level."""
        block = (self.top & -self.top).bit_length() - 1
        bits = self.mid[block]
        word = (block << 6) | ((bits & -bits).bit_length() - 1)
        bits = self.low[word]
        return (word << 6) | ((bits & -bits).bit_length() - 1)

    def place(self, rank: int, position: int) -> None:
        """One position into a bucket that is kept as a heap."""
        if self.buckets[rank]:
            heappush(self.buckets[rank], position)
        else:
            self.push(rank, position)

    def take(self) -> tuple[int, int]:
        """The leftmost position of the lowest rank, whose bucket is a heap."""
        rank = self.lowest()
        if len(self.buckets[rank]) > 1:
            return rank, heappop(self.buckets[rank])
        return rank, self.pop()[1][0]

    def pop(self) -> tuple[int, list]:
        """The lowest filled rank and all its entries; call only while ``top`` is not zero."""
        rank = self.lowest()
        word, block = rank >> 6, rank >> 12
        self.low[word] &= ~(1 << (rank & 63))
        if not self.low[word]:
            self.mid[block] &= ~(1 << (word & 63))
            if not self.mid[block]:
                self.top &= ~(1 << block)
        entries, self.buckets[rank] = self.buckets[rank], []
        return rank, entries


class ByteBpe:
    """Ids are ranks. Encodes pre-tokens with the rank queue, many at a time."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        # pairs of ids that join to a token, as left << 32 | right
        pairs = {
            self.ranks[t[:cut]] << 32 | self.ranks[t[cut:]]: rank
            for t, rank in self.ranks.items()
            for cut in range(1, len(t))
            if t[:cut] in self.ranks and t[cut:] in self.ranks
        }
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        # tokens that can merge further before the rank that made them: their occurrences are
        # applied one by one, since the next choice in the pre-token may lie elsewhere
        made = np.array([r if len(t) > 1 else -1 for r, t in enumerate(self.tokens)])
        self.one_by_one = np.zeros(len(self.tokens), bool)
        for side in (self.keys >> 32, self.keys & 0xFFFFFFFF):
            self.one_by_one[side[self.joined < made[side]]] = True
        self.queue = RankQueue(len(self.tokens))
        self.matches = regex.compile(pattern).findall
        self.chunk = re.compile(r"\s*\S+|\s+").findall
        self.cache, self.parts = WordCache(150_000), WordCache(250_000)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.joined[at], -1)

    def merge(self, parts: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens."""
        if any(len(p) > LONG for p in parts):
            short = iter(self.merge([p for p in parts if len(p) <= LONG]))
            return [self.merge_long(p) if len(p) > LONG else next(short) for p in parts]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        n = int(lengths.sum())
        if not n:
            return [b""] * len(parts)
        owner = np.repeat(np.arange(len(parts)), lengths)
        ids = self.single[np.frombuffer(b"".join(parts), np.uint8)]
        # links between neighbours of one pre-token; n stands for none
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        edge = np.flatnonzero(owner[1:] != owner[:-1])
        after[edge], before[edge + 1] = n, n
        after[n - 1], before[0] = n, n
        current = np.full(n + 1, -1)  # rank of the pair that starts here, -1: none or merged away
        starts = np.flatnonzero(after[:n] < n)
        ranks = self._rank(ids[starts], ids[starts + 1])
        current[starts] = ranks
        queue, pairs = self.queue, self.pairs
        if (ranks >= 0).any():
            queue.push_all(ranks[ranks >= 0], starts[ranks >= 0])
        while queue.top:
            rank, entries = queue.pop()
            if len(entries) == 1 and (isinstance(entries[0], int) or len(entries[0]) == 1):
                i = int(entries[0] if isinstance(entries[0], int) else entries[0][0])
                if current[i] != rank:
                    continue  # stale: one side has been merged since
                gone = int(after[i])
                right, left = int(after[gone]), int(before[i])
                ids[i], after[i], current[i], current[gone], ids[gone] = rank, right, -1, -1, -1
                if right < n:
                    before[right] = i
                    found = pairs.get(rank << 32 | int(ids[right]))
                    if found is not None:
                        current[i] = found
                        queue.push(found, i)
                if left < n:
                    found = pairs.get(int(ids[left]) << 32 | rank)
                    current[left] = -1 if found is None else found
                    if found is not None:
                        queue.push(found, left)
                continue
            at = np.concatenate([np.atleast_1d(e) for e in entries]) if len(entries) > 1 else entries[0]
            at = np.unique(at[current[at] == rank])
            if not len(at):
                continue
            # overlapping pairs ("aaa"): every second one of a run, from the left
            fresh = np.ones(len(at), bool)
            fresh[1:] = after[at[:-1]] != at[1:]
            index = np.arange(len(at))
            take = (index - np.maximum.accumulate(np.where(fresh, index, 0))) % 2 == 0
            if self.one_by_one[rank]:
                opening = np.ones(len(at), bool)
                opening[1:] = owner[at[1:]] != owner[at[:-1]]
                rest = at[~opening]
                if len(rest):
                    queue.push(rank, rest)
                take &= opening
            at = at[take]
            gone = after[at]
            right = after[gone]
            ids[at], ids[gone], current[gone], after[at] = rank, -1, -1, right
            before[right] = at  # position n takes what has no right neighbour
            left = before[at]
            redo = np.concatenate([at, left[left < n]])
            current[redo] = -1
            redo = np.unique(redo[after[redo] < n])
            if len(redo):
                ranks = self._rank(ids[redo], ids[after[redo]])
                current[redo] = ranks
                hit = ranks >= 0
                if hit.any():
                    queue.push_all(ranks[hit], redo[hit])
        alive = ids >= 0
        counts = np.bincount(owner[alive], minlength=len(parts))
        packed, stops = ids[alive].astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        return [packed[a:b] for a, b in zip([0, *stops], stops)]

    def merge_long(self, data: bytes) -> bytes:
        """Packed ids of one pre-token, merge by merge, leftmost first within a rank."""
        n, queue, pairs = len(data), self.queue, self.pairs
        ids = self.single[np.frombuffer(data, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        current = [-1] * n  # rank of the pair that starts here
        for i in range(n - 1):  # ascending positions are a heap
            found = pairs.get(ids[i] << 32 | ids[i + 1])
            if found is not None:
                current[i] = found
                queue.push(found, i)
        while queue.top:
            rank, i = queue.take()
            if current[i] != rank:
                continue
            gone = after[i]
            right, left = after[gone], before[i]
            ids[i], after[i], ids[gone], current[gone], current[i] = rank, right, -1, -1, -1
            if right < n:
                before[right] = i
                found = pairs.get(rank << 32 | ids[right])
                if found is not None:
                    current[i] = found
                    queue.place(found, i)
            if left >= 0:
                found = pairs.get(ids[left] << 32 | rank)
                current[left] = -1 if found is None else found
                if found is not None:
                    queue.place(found, left)
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Packed ids of chunks that are not in the cache."""
        self.parts.trim()
        known, passing, new = self.parts, {}, []
        split = [self.matches(c) for c in chunks]
        for part in set().union(*split).difference(known) if split else ():
            data = part.encode()
            rank = self.ranks.get(data)
            if rank is None:
                new.append((part, data))
            else:
                (known if len(part) <= known.longest else passing)[part] = rank.to_bytes(4, "little")
        for (part, _), packed in zip(new, self.merge([d for _, d in new])):
            (known if len(part) <= known.longest else passing)[part] = packed
        return {c: b"".join([known[p] if p in known else passing[p] for p in parts]) for c, parts in zip(chunks, split)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        out, held, size = [[] for _ in texts], [], 0

        def settle() -> None:
            cache = self.cache
            cache.trim()
            passing = {}
            for c, packed in self._learn(list(set().union(*(chunks for _, chunks in held)).difference(cache))).items():
                (cache if len(c) <= cache.longest else passing)[c] = packed
            for i, chunks in held:
                out[i].append(b"".join([cache[c] if c in cache else passing[c] for c in chunks] if passing else map(cache.__getitem__, chunks)))

        for i, text in enumerate(texts):
            for piece in windows(text):
                held.append((i, self.chunk(piece)))
                size += len(piece)
                if size > 1 << 22:
                    settle()
                    held, size = [], 0
        settle()
        return [b"".join(x) for x in out]

    def forget(self) -> None:
        """Empty the caches at the end of a task: the worker goes on to other work."""
        self.cache.clear()
        self.parts.clear()

    def decode(self, packed: bytes) -> bytes:
        """Bytes of a whole text from its ids."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def _coder(vocabulary: str, pattern: str | None) -> ByteBpe:
    def load() -> ByteBpe:
        if pattern is not None:
            return ByteBpe(vocabulary_path(vocabulary), pattern)
        import public_tokenizers

        return ByteBpe(vocabulary_path(vocabulary), public_tokenizers.PATTERN)

    return worker_state(("byte_bpe", vocabulary, pattern), load)


def with_ids(
    df: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", text: str = "text", out: str = "ids",
    pattern: str | None = None,
) -> DataFrame:
    """``df`` with the ids of every whole text (binary, 4 bytes an id, little-endian)."""

    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(vocabulary, pattern)
        for texts in batches:
            yield pa.array(coder.encode(texts.to_pylist()), pa.binary())
        coder.forget()

    return df.withColumn(out, encode(text_of(text)))


def with_text(
    df: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", ids: str = "ids", out: str = "decoded",
    pattern: str | None = None,
) -> DataFrame:
    """``df`` with the bytes that the packed ids stand for; NULL ids give NULL."""

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(vocabulary, pattern)
        for packed in batches:
            yield pa.array([None if p is None else coder.decode(p) for p in packed.to_pylist()], pa.binary())

    return df.withColumn(out, decode(F.col(ids)))


def with_digests(df: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", text: str = "text", out: str = "coded") -> DataFrame:
    """``df`` with a struct: n_tokens, digest of the ids, digest of the decoded bytes. Encodes,
    decodes and digests a text in one pass, so ids never leave the worker."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(vocabulary, None)
        for texts in batches:
            n, ids, decoded = [], [], []
            for packed in coder.encode(texts.to_pylist()):
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(packed)).hexdigest())
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["n_tokens", "ids_sha256", "decoded_sha256"],
            )
        coder.forget()

    return df.withColumn(out, digest(text_of(text)))


def round_trip(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return with_digests(docs.select("doc_id", "text"), vocabulary).select("doc_id", "coded.*")


def tokenised(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Per document: doc_id, lang, source, n_tokens and ids (array of integers)."""
    coded = with_ids(docs.select("doc_id", "lang", "source", "text"), vocabulary).drop("text")
    return coded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
