"""Benchmark passages in documents, exact or with a few edits.

Method: q-gram lemma filtering. Texts are lower-cased with white space runs as one space.
Searched are windows of benchmark items: every run of ``RUN_WORDS`` words (from each word on), and
overlapping windows of ``window`` characters (shorter items whole); a window of m characters may
differ by e = rate * m edits. A region with at most e edits shares at least m - q + 1 - q * e
q-grams with its window, all on e + 1 neighbouring diagonals. An item's q-grams are indexed once;
hits are gathered in overlapping bands of diagonals, in order of their place in the item, so that a
window's hits are a stretch of its band. Windows that reach the bound are verified by alignment
inside the band, the likeliest of an item first.

The benchmark is read in blocks of at most ``block_chars`` characters; the index of a block has a
fixed maximal size and is broadcast, documents are never shuffled. With more blocks the documents
are read once per block.

Defined results: NULL text counts as empty; items shorter than ``min_chars`` characters are
found only without edits and as whole words, blank ones never; a word has a letter or digit, and in scripts without spaces
four characters count as one; a run ends after ``LONGEST`` characters; an item occurs once in a document's list however often its
windows match; spans are character positions in the normalised text; every row is reported.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import plain_name, share, shared_value, text_of

Q = 8  # a power of two
WINDOW, STRIDE, MIN_CHARS = 128, 64, 24
RUN_WORDS = 13
LONGEST = WINDOW + STRIDE  # a verbatim run of so many characters has a window of characters inside
RATE = 0.1
LEAST_HITS = 4
BLOCK_CHARS = 1 << 20
HELD_CHARS = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15
# Thai to Tibetan, Myanmar, Khmer, kana, CJK and its punctuation, full-width forms
_DENSE = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3000-\u30ff\u3400-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff"
_TOKEN = re.compile(f"[{_DENSE}]{{1,4}}|[^ {_DENSE}]+")
_SPELLED = re.compile(r"[^\W_]")
_JOINED = f"[^\\W_{_DENSE}]"  # continues a word


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def spans_of(text: str, window: int = WINDOW, stride: int = STRIDE, words: int = RUN_WORDS) -> list[tuple[int, int]]:
    """Places (start, stop) of a normalised item's windows: every run of ``words`` words, and of
    every run of window + stride characters at least ``window`` characters."""
    last = len(text) - window
    found = {(s, s + window) for s in [*range(0, last, stride), last]} if last > 0 else {(0, len(text))}
    tokens = [m.span() for m in _TOKEN.finditer(text) if _SPELLED.search(m.group())]
    end = words - 1
    for i, (start, _) in enumerate(tokens):
        end = max(end, i + words - 1)
        while end < len(tokens) and tokens[end][1] - start < MIN_CHARS:
            end += 1
        if end >= len(tokens):
            break
        found.add((start, min(tokens[end][1], start + LONGEST)))
    return sorted(found)


def pieces_of(text: str, window: int = WINDOW, stride: int = STRIDE) -> list[str]:
    """The windows of a normalised item."""
    return [text[s:e] for s, e in spans_of(text, window, stride)]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def gram_hashes(symbols: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q symbols that start at each position."""
    out, base, size = symbols.astype(np.uint64) + np.uint64(1), MULTIPLIER, 1
    while size < q:
        if len(out) <= size:
            return np.zeros(0, np.uint64)
        out = out[:-size] * np.uint64(base) + out[size:]
        base = base * base % 2**64
        size *= 2
    return out * np.uint64(MULTIPLIER)


def run_hashes(symbols: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n symbols that start at each position, for any n."""
    power = 1 << (n.bit_length() - 1)
    grams = gram_hashes(symbols, power)
    most = max(0, len(symbols) - n + 1)
    return (grams[:most] * np.uint64(MULTIPLIER)) ^ grams[n - power : n - power + most]


def edit_budget(length: int, rate: float = RATE, q: int = Q) -> int:
    """Edits allowed so that the lemma still asks for ``LEAST_HITS`` q-grams."""
    return max(0, min(int(rate * length), (length - q + 1 - LEAST_HITS) // q))


def align(pattern: np.ndarray, region: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Best (edits, start, end) of the whole pattern inside ``region`` along diagonals low..high
    (region position minus pattern position); None above ``budget``."""
    width = high - low + 1
    big = len(pattern) + len(region) + 1
    column = np.arange(width)
    at = column + low  # region position before the first row
    cost = np.where((at >= 0) & (at <= len(region)), 0, big)
    origin = at.copy()
    # region symbols along the band's diagonals, one more row each step; -1 outside
    padded = np.full(len(region) + 2 * big, -1, np.int64)
    padded[big : big + len(region)] = region
    shifted, moved = np.full(width, big), np.zeros(width, np.int64)
    for i, symbol in enumerate(pattern.tolist()):
        at = low + i
        row = padded[big + at : big + at + width]
        step = cost + (row != symbol)
        step[row < 0] = big
        shifted[:-1], moved[:-1] = cost[1:], origin[1:]
        better = shifted + 1 < step  # pattern symbol left out: from the next diagonal
        step = np.where(better, shifted + 1, step)
        come = np.where(better, moved, origin)
        # region symbols inserted: along the row, each costs one
        flat = step - column
        lowest = np.minimum.accumulate(flat)
        source = np.maximum.accumulate(np.where(flat == lowest, column, 0))
        cost, origin = np.minimum(lowest + column, big), come[source]
        if at + 1 < 0 or at + width > len(region):
            cost[: max(0, -at - 1)] = big
            cost[max(0, len(region) - at) :] = big
        if cost.min() > budget:
            return None
    best = int(cost.argmin())
    return int(cost[best]), int(origin[best]), best + low + len(pattern)


@dataclass
class GramIndex:
    """Sorted q-gram hashes of a block of items and the items' windows, by start."""

    items: list[int | None]
    text: str
    hashes: np.ndarray
    place: np.ndarray
    known: np.ndarray
    shift: int
    owner: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    budget: np.ndarray
    bound: np.ndarray
    short: list[tuple[int | None, str]]
    short_hashes: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: sorted hashes, places in ``short``

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        return self.known[hashes >> np.uint64(self.shift)]


def build_index(items: list[tuple[int | None, str]], rate: float = RATE) -> GramIndex:
    short = [i for i in items if len(i[1]) < MIN_CHARS]
    items = [i for i in items if len(i[1]) >= MIN_CHARS]
    short_hashes = {}
    for n in {len(t) for _, t in short}:
        own = np.array([k for k, (_, t) in enumerate(short) if len(t) == n])
        keys = np.concatenate([run_hashes(codes(short[k][1]), n) for k in own])
        order = np.argsort(keys, kind="stable")
        short_hashes[n] = keys[order], own[order]
    windows, places, grams, at = [], [], [], 0
    for owner, (_, text) in enumerate(items):
        windows += [(owner, at + s, at + e) for s, e in spans_of(text)]
        grams.append(gram_hashes(codes(text)))
        places.append(at + np.arange(len(grams[-1])))
        at += len(text) + 1
    hashes = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    order = np.argsort(hashes, kind="stable")
    bits = max(16, (16 * len(hashes)).bit_length())
    known = np.zeros(1 << bits, bool)
    known[hashes >> np.uint64(64 - bits)] = True
    owner, start, stop = np.array(windows, np.int64).reshape(-1, 3).T
    budget = np.array([edit_budget(n, rate) for n in (stop - start).tolist()], np.int64)
    bound = np.maximum(stop - start - Q + 1 - Q * budget, 1)
    return GramIndex(
        [i for i, _ in items], "\0".join(t for _, t in items), hashes[order],
        np.concatenate(places or [np.zeros(0, np.int64)])[order], known, 64 - bits, owner, start, stop, budget, bound,
        short, short_hashes,
    )


def spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each row, ``counts`` of them."""
    return np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def add_short(index: GramIndex, texts: list[str], out: list[dict]) -> None:
    """Add the short items that occur in each text as whole words."""
    symbols = codes("\0".join(texts))
    starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    for n, (keys, own) in index.short_hashes.items():
        hashes = run_hashes(symbols, n)
        maybe = np.zeros(1 << 16, bool)
        maybe[keys >> np.uint64(48)] = True
        at = np.flatnonzero(maybe[hashes >> np.uint64(48)])
        first, last = np.searchsorted(keys, hashes[at], "left"), np.searchsorted(keys, hashes[at], "right")
        doc = np.repeat(np.searchsorted(starts, at, "right") - 1, last - first)
        pairs = np.unique(np.stack([own[spread(first, last - first)], doc], 1), axis=0)
        for k, d in pairs.tolist():
            item, text = index.short[k]
            sides = [("(?<!%s)", text[0]), ("(?!%s)", text[-1])]
            before, after = (side % _JOINED if re.match(_JOINED, edge) else "" for side, edge in sides)
            hit = re.search(before + re.escape(text) + after, texts[d])
            if hit and out[d].get(item, (1,))[0] > 0:
                out[d][item] = (0, *hit.span())


def find(index: GramIndex, texts: list[str]) -> list[list[tuple]]:
    """Per normalised text: verified (item, edits, start, end), one per item."""
    out = near(index, texts)
    if index.short and texts:
        add_short(index, texts, out)
    return [sorted(((item, *m) for item, m in d.items()), key=lambda m: (m[0] is None, m[0])) for d in out]


def near(index: GramIndex, texts: list[str]) -> list[dict]:
    """Per normalised text: item to verified (edits, start, end) of its best window."""
    out: list[dict] = [{} for _ in texts]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    symbols = codes("\0".join(texts))
    hashes = gram_hashes(symbols)
    at = np.flatnonzero(index.maybe(hashes)) if len(hashes) and len(index.hashes) else np.zeros(0, np.int64)
    if not len(at):
        return out
    first, last = np.searchsorted(index.hashes, hashes[at], "left"), np.searchsorted(index.hashes, hashes[at], "right")
    counts = last - first
    at, first, counts = at[counts > 0], first[counts > 0], counts[counts > 0]
    if not len(at):  # all were chance hits of the filter
        return out
    spot = index.place[spread(first, counts)]
    place = np.repeat(at, counts)
    owner = np.searchsorted(starts, place, "right") - 1
    # diagonals moved so that they are never negative; a band holds those of any window's budget
    size, width = len(index.text) + 1, int(index.budget.max()) + 1
    band = (place - spot + size) // width
    most = int(band.max()) + 1
    group = owner * most + band
    least, longest = int(index.bound.min()), int((index.stop - index.start).max())
    # only bands that reach the least bound with a neighbour
    bands, of, hits = np.unique(group, return_inverse=True, return_counts=True)
    pair = hits[:-1] + np.where(np.diff(bands) == 1, hits[1:], 0)
    full = (np.maximum(np.r_[hits[-1:] * 0, pair], np.r_[pair, hits[-1:]]) >= least)[of]
    group, band, spot = group[full], band[full], spot[full]
    # a repeated q-gram hits often: each place of the item counts once
    hits = np.unique(np.concatenate([group, np.where(band > 0, group - 1, group)]) * size + np.concatenate([spot, spot]))
    group, spot = hits // size, hits % size
    # first hits of a window: so many follow within the longest one
    ahead = np.flatnonzero(hits[least - 1 :] - hits[: len(hits) - least + 1] <= longest - Q) if len(hits) >= least else []
    ahead = np.asarray(ahead, np.int64)
    ahead = ahead[group[ahead + least - 1] == group[ahead]]
    # each window by its first hit: it starts after the hit before
    before = np.where((ahead > 0) & (group[ahead - 1] == group[ahead]), spot[ahead - 1], -1)
    low = np.searchsorted(index.start, np.maximum(before + 1, spot[ahead] - longest + 1), "left")
    counts = np.searchsorted(index.start, spot[ahead], "right") - low
    window, head = spread(low, counts), np.repeat(ahead, counts)
    shared = np.searchsorted(hits, group[head] * size + np.maximum(index.stop[window] - Q + 1, 0), "left") - head
    enough = shared >= index.bound[window]
    window, key, shared = window[enough], group[head[enough]], shared[enough]
    # every edit costs at most Q shared q-grams
    fewest = -(-np.maximum(index.stop[window] - index.start[window] - Q + 1 - shared, 0) // Q)
    for i in np.lexsort((key, window, fewest)).tolist():
        w, doc = int(window[i]), int(key[i]) // most
        item, budget = index.items[index.owner[w]], int(index.budget[w])
        known = out[doc].get(item)
        if known:
            budget = min(budget, known[0] - 1)
        if fewest[i] > budget:
            continue  # no better than what is known of this item
        start, stop = int(index.start[w]), int(index.stop[w])
        pattern, shift = index.text[start:stop], start - int(starts[doc])
        low = int(key[i]) % most * width - size + shift
        high = low + 2 * width - 1
        begin, end = max(0, low - budget), min(len(texts[doc]), high + len(pattern) + budget)
        region = texts[doc][begin:end]
        exact = region.find(pattern)
        if exact >= 0:
            found = (0, exact, exact + len(pattern))
        else:
            found = align(codes(pattern), codes(region), low - begin, high - begin, budget)
        if found and found[0] <= budget:
            out[doc][item] = (found[0], begin + found[1], begin + found[2])
    return out


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int = BLOCK_CHARS) -> Iterator[list]:
    """Normalised items in blocks of at most ``block_chars`` characters (or one item)."""
    block, size = [], 0
    for item, raw in benchmark.select(item_id, text).toLocalIterator():
        norm = normalise(raw)
        if not norm:
            continue
        if block and size + len(norm) > block_chars:
            yield block
            block, size = [], 0
        block.append((item, norm))
        size += len(norm)
    if block:
        yield block


MATCHES = "array<struct<item_id long, edits int, start long, stop long>>"


def with_matches(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "matches", rate: float = RATE,
    item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``docs`` with an array of the benchmark items found in each text."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))
    names = ("item_id", "edits", "start", "stop")

    def search(shared):
        @F.arrow_udf(MATCHES)
        def matches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            index = shared_value(shared)
            for batch in batches:
                found, held, size = [], [], 0
                for raw in batch.to_pylist():
                    held.append(normalise(raw))
                    size += len(held[-1])
                    if size > HELD_CHARS:
                        found += find(index, held)
                        held, size = [], 0
                if held:
                    found += find(index, held)
                yield pa.array([[dict(zip(names, m)) for m in ms] for ms in found], kind)

        return matches(text_of(text))

    columns, result = [], docs
    for block in benchmark_blocks(benchmark, item_id, item_text, block_chars):
        name = plain_name(result, "_matches")
        result = result.withColumn(name, search(share(docs.sparkSession, build_index(block, rate))))
        columns.append(name)
    empty = F.array().cast(MATCHES)
    joined = F.array_sort(F.concat(*[F.col(c) for c in columns])) if columns else empty
    return result.withColumn(out, joined).drop(*columns)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, contaminated, item_ids, least_edits."""
    found = with_matches(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", (F.size("matches") > 0).alias("contaminated"), F.array_distinct("matches.item_id").alias("item_ids"),
        F.array_min("matches.edits").alias("least_edits"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage."""
    out = plain_name(docs, "_found")
    return with_matches(docs, benchmark, out=out).filter(F.size(out) == 0).drop(out)
