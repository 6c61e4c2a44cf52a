"""Language-model scores of whole documents by deleted interpolation.

Model: P(w | v) = L(b) * c(v w) / c(v) + (1 - L(b)) * (c(w) + 0.1) / (N + 0.1 (V + 1)), with b the
bucket of the context's frequency (powers of two). The weights L are learned by expectation
maximisation on held-out counts: every training token is deleted from the counts in turn
(c - 1), so all training data serve both. What EM needs of a token is its bucket and the ratio
of the two estimates, so a histogram per bucket is enough; its size does not depend on the data.

How the counts reach the documents: documents are packed into blocks of about ``block_tokens``
tokens, once. A block asks for the counts of its distinct words and word pairs, as sorted
64-bit hashes cut into ``parts`` by their leading bits; one group per part adds up what all blocks
have of its keys and answers each block in the order it asked. Only aggregated keys move, words
common to all documents count once per block, and no task holds more than a part or a block.
Nothing of the corpus is collected or broadcast but N, V and the histogram.

Defined results: NULL text counts as empty (its only token is the end); a NULL id counts as the
empty text in the split; without training documents every token has probability one; repeated
rows are documents of their own.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from sightlake.session import materialize

from .common import crc_of_id, text_of

ADD = 0.1
FOLDS = 10
BLOCK_TOKENS = 1 << 21
PART_KEYS = 1 << 21
MIN_PARTS = 64
END_WORD, START_WORD = b" end", b" start"  # no word has a space
BUCKETS, BINS, BIN = 48, 640, 0.1  # bins of the ratio's natural logarithm, from -32 to 32


def held_out(doc_id: str = "doc_id") -> Column:
    return crc_of_id(doc_id) % FOLDS == 0


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def planes(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values with bytes of equal weight together, which the codecs compress."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def word_key(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word) | 1


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right + (left >> np.uint64(23)))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed ^ (mixed >> np.uint64(32))) & ~np.uint64(1)


BLOCK = "block long, doc_ids array<long>, train array<boolean>, lengths array<long>, vocabulary binary, tokens binary, n_tokens long, n_train long"


def pack_blocks(docs: DataFrame, doc_id: str, text: str, train: Column, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents as token numbers of their block: 0 the end, 1 the start, then words."""
    schema = pa.schema([
        ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())),
        ("vocabulary", pa.binary()), ("tokens", pa.binary()), ("n_tokens", pa.int64()), ("n_train", pa.int64()),
    ])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def fresh() -> tuple:
            return _Index({END_WORD: 0, START_WORD: 1}), [], [], [], []

        def row(index, ids, train_, lengths, parts) -> pa.RecordBatch:
            keys = np.fromiter(map(word_key, index), np.uint64, len(index))
            tokens = np.concatenate(parts)
            used = int(np.array(lengths)[np.array(train_, bool)].sum())
            narrow = tokens.view(np.uint8).reshape(-1, 4).T.tobytes()
            values = [number, ids, train_, lengths, planes(keys), narrow, len(tokens), used]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

        index, ids, train_, lengths, parts = fresh()
        n = 0
        for batch in batches:
            for doc, data, learns in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = data.lower().split()  # bytes: only A-Z and the six ASCII spaces
                numbers = np.zeros(len(words) + 1, "<u4")
                numbers[:-1] = np.fromiter(map(index.__getitem__, words), np.uint32, len(words))
                ids.append(doc)
                train_.append(learns)
                lengths.append(len(numbers))
                parts.append(numbers)
                n += len(numbers)
                if n >= block_tokens:
                    yield row(index, ids, train_, lengths, parts)
                    number += 1
                    index, ids, train_, lengths, parts = fresh()
                    n = 0
        if n:
            yield row(index, ids, train_, lengths, parts)

    rows = docs.select(F.col(doc_id).cast("long"), text_of(text).cast("binary"), train)
    return materialize(rows.mapInArrow(pack, BLOCK), "lm-blocks")


class Block:
    """A block's tokens with its distinct words and pairs; ``keys`` are sorted."""

    def __init__(self, row: dict):
        self.doc_ids, self.train = row["doc_ids"], np.array(row["train"], bool)
        self.lengths = np.array(row["lengths"], np.int64)
        words = from_planes(row["vocabulary"])
        tokens = np.ascontiguousarray(np.frombuffer(row["tokens"], np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.starts] = 1
        n = len(words)
        pairs, pair = np.unique(before * n + tokens, return_inverse=True)
        learns = np.repeat(self.train, self.lengths)
        self.tokens, self.pair = tokens, pair.ravel()
        self.left, self.right = pairs // n, pairs % n
        word_n = np.bincount(tokens[learns], minlength=n)
        self.pair_n = np.bincount(self.pair[learns], minlength=len(pairs))
        keys = np.r_[words, pair_keys(words[self.left], words[self.right])]
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.own = np.r_[word_n, self.pair_n].astype(np.uint64)[self.order]
        self.n_words = n

    def cuts(self, bits: int) -> np.ndarray:
        """Bounds of the parts in ``keys``."""
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        return np.r_[0, np.searchsorted(self.keys, edges), len(self.keys)]

    def answered(self, parts: dict[int, bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts of words and pairs from the parts' answers."""
        cuts, counts = self.cuts(bits), np.zeros(len(self.keys), np.int64)
        sorted_ = np.zeros(len(self.keys), np.int64)
        for part, data in parts.items():
            sorted_[cuts[part] : cuts[part + 1]] = from_planes(data)
        counts[self.order] = sorted_
        words = counts[: self.n_words].copy()
        words[1] = words[0]  # every text has one start and one end
        return words, counts[self.n_words :]


def _table(row_lists: list, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(row_lists, schema)], schema=schema)


def count_keys(blocks: DataFrame, bits: int) -> DataFrame:
    """Answers (block, part, counts); per part a row with block -1 and its number of training words."""
    asked = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("own", pa.binary())])
    answer = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("counts", pa.binary()), ("types", pa.int64())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                cuts = block.cuts(bits)
                for p in range(1 << bits):
                    a, b = cuts[p], cuts[p + 1]
                    if b > a:
                        steps = np.r_[block.keys[a], np.diff(block.keys[a:b])]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([p], pa.int32()), pa.array([row["block"]]), pa.array([planes(steps)]), pa.array([planes(block.own[a:b])])],
                            schema=asked,
                        )

    def add(group: pa.Table) -> pa.Table:
        blocks_, part = group.column("block").to_pylist(), group.column("part")[0].as_py()
        steps = [from_planes(k.as_py()) for k in group.column("keys")]
        sizes = [len(s) for s in steps]
        keys = np.concatenate([np.cumsum(s, dtype=np.uint64) for s in steps])
        own = np.concatenate([from_planes(c.as_py()) for c in group.column("own")])
        known, at = np.unique(keys, return_inverse=True)
        order = np.argsort(at.ravel(), kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(at.ravel()[order]) != 0])
        total = np.add.reduceat(own[order], first)
        types = int(((known & np.uint64(1)) == 1)[total > 0].sum())
        back = np.split(total[at.ravel()], np.cumsum(sizes)[:-1])
        return _table([[*blocks_, -1], [part] * (len(blocks_) + 1), [*map(planes, back), b""], [0] * len(blocks_) + [types]], answer)

    requests = blocks.mapInArrow(ask, "part int, block long, keys binary, own binary")
    totals = requests.groupBy("part").applyInArrow(add, "block long, part int, counts binary, types long")
    return materialize(totals, "lm-counts")


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, then one bucket per power of two."""
    return np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def ratio_histogram(block: Block, words: np.ndarray, pairs: np.ndarray, n: int, v: int) -> np.ndarray:
    """Per (bucket, bin): weight and sum of log ratios of the deleted estimates of all training
    tokens; bin 0 holds those whose pair occurs once."""
    own = block.pair_n > 0
    weight = block.pair_n[own]
    context, joint, single = words[block.left[own]] - 1, pairs[own] - 1, words[block.right[own]] - 1
    low = (single + ADD) / (max(n - 1, 0) + ADD * (v + 1))
    seen = joint > 0
    ratio = np.zeros(len(weight))
    ratio[seen] = np.log(joint[seen] / context[seen] / low[seen])
    bins = np.where(seen, np.clip((ratio + BIN * BINS / 2) / BIN, 1, BINS - 1).astype(np.int64), 0)
    cell = bucket_of(context) * BINS + bins
    return np.stack([np.bincount(cell, w, BUCKETS * BINS) for w in (weight, weight * ratio)])


def learn_weights(cells: list[tuple[int, float, float]], steps: int = 200) -> np.ndarray:
    """Weight of the pair estimate per bucket, from (cell, weight, log ratio sum)."""
    out = np.zeros(BUCKETS)
    held = np.zeros((2, BUCKETS * BINS))
    for cell, weight, ratio in cells:
        held[:, cell] += weight, ratio
    for b in range(1, BUCKETS):
        weight, ratio = (x[b * BINS : (b + 1) * BINS] for x in held)
        if not weight.sum():
            out[b] = out[b - 1]
            continue
        seen = weight > 0
        r = np.where(np.arange(BINS) == 0, 0.0, np.exp(np.divide(ratio, weight, out=np.zeros(BINS), where=seen)))[seen]
        weight, lam = weight[seen], 0.5
        for _ in range(steps):
            new = float((weight * lam * r / (lam * r + 1 - lam)).sum() / weight.sum())
            if abs(new - lam) < 1e-9:
                break
            lam = new
        out[b] = min(lam, 0.9999)  # an unseen pair keeps a probability
    return out


def score_documents(
    docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS, part_keys: int = PART_KEYS
) -> DataFrame:
    """Per document: doc_id, train, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    blocks = pack_blocks(docs, doc_id, text, train, block_tokens)
    sums = blocks.agg(F.sum("n_tokens"), F.sum("n_train")).first()
    n = int(sums[1] or 0)
    bits = max(MIN_PARTS - 1, -(-2 * int(sums[0] or 0) // part_keys)).bit_length()
    answers = count_keys(blocks, bits)
    v = int(answers.filter("block = -1").agg(F.sum("types")).first()[0] or 0)
    both = lambda: blocks.groupBy("block").cogroup(answers.filter("block >= 0").select("block", "part", "counts").groupBy("block"))

    def load(left: pa.Table, right: pa.Table) -> tuple:
        block = Block(left.to_pylist()[0])
        return block, *block.answered(dict(zip(right.column("part").to_pylist(), right.column("counts").to_pylist())), bits)

    cell_schema = pa.schema([("cell", pa.int64()), ("weight", pa.float64()), ("ratio", pa.float64())])

    def cells(left: pa.Table, right: pa.Table) -> pa.Table:
        weight, ratio = ratio_histogram(*load(left, right), n, v)
        at = np.flatnonzero(weight)
        return _table([at, weight[at], ratio[at]], cell_schema)

    found = both().applyInArrow(cells, "cell long, weight double, ratio double")
    # at most BUCKETS * BINS rows
    weights = learn_weights([tuple(r) for r in found.groupBy("cell").agg(F.sum("weight"), F.sum("ratio")).collect()])
    result = pa.schema([
        ("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
        ("base_score", pa.float64()), ("score", pa.float64()),
    ])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        block, words, pairs = load(left, right)
        low = (words + ADD) / (n + ADD * (v + 1))
        context = words[block.left]
        lam = weights[bucket_of(context)]
        joint = lam * pairs / np.maximum(context, 1) + (1 - lam) * low[block.right]
        per_document = lambda x: np.add.reduceat(x, block.starts)
        return _table([
            block.doc_ids, block.train, block.lengths, per_document((words[block.tokens] > 0).astype(np.int64)), np.full(len(block.lengths), n),
            per_document(np.log10(low)[block.tokens]), per_document(np.log10(joint)[block.pair]),
        ], result)

    return both().applyInArrow(
        score, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def corpus_scores(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    scored = score_documents(docs.select("doc_id", "text"), ~held_out())
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
