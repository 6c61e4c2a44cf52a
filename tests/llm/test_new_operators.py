"""Alignment, packing and whitening against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import types as T
from tokenizers import Tokenizer

from sightlake.llm import alignment, cached_ids, packing, whitening

from .conftest import ODD

BYTES = {flag: Tokenizer.from_file(P.path("byte_bpe_50k.json")) for flag in (False, True)}
WORDS = {flag: Tokenizer.from_file(P.path("word_bpe_49k.json")) for flag in (False, True)}
for kind in (BYTES, WORDS):
    kind[True].encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
ALPHABET = " \n\t  aeinorstAEÉéßıİςΣſK▁<|>'s1²½!.,;:?_\x1c\x85　\0\x0b̈日本🤗ﬁ"
TEXT = st.text(st.one_of(st.sampled_from(ALPHABET), st.characters(exclude_categories=["Cs"])), max_size=60)
SPECIAL = st.sampled_from(["", "<|endoftext|>", " <|startoftext|> ", "</s>", "<unk>", "<0x41>", "don't, 'RE.", "a!\x1cb", "word,, word.)"])


@pytest.fixture(scope="module")
def encoders():
    return {
        (kind, flag): cls(P.path(name), special_as_text=flag)
        for kind, cls, name in (("bytes", cached_ids.ByteLevelIds, "byte_bpe_50k.json"), ("words", cached_ids.WordIds, "word_bpe_49k.json"))
        for flag in (False, True)
    }


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


@settings(max_examples=200, deadline=None)
@given(parts=st.lists(st.tuples(TEXT, SPECIAL), max_size=4))
def test_ids_of_any_text(encoders, parts):
    texts = [a + b + a for a, b in parts]
    for (kind, flag), encoder in encoders.items():
        library = (BYTES if kind == "bytes" else WORDS)[flag]
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(p, "<u4").tolist() for p in encoder.encode(texts)] == want


def plain_alignment(aligner, text):
    """Tokens of both sides, groups as text, links as (a, b) -> times."""
    nothing = 0, 0, 0, "", Counter()
    if not text:
        return nothing
    a, b = BYTES[True].encode(" " + text, add_special_tokens=False).ids, PIECES.encode(text)
    raw_a, raw_b = [aligner.bytes_a[i] for i in a], [aligner.bytes_b[i] for i in b]
    if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
        return nothing
    ends_a, ends_b = np.cumsum(list(map(len, raw_a))).tolist(), np.cumsum(list(map(len, raw_b))).tolist()
    groups, links, i, j = [], Counter(), 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        links.update((p, q) for p in a[i:x] for q in b[j:y])
        i, j = x, y
    return len(a), len(b), len(groups), ";".join(groups), links


@settings(max_examples=200, deadline=None)
@given(parts=st.lists(st.tuples(TEXT, SPECIAL), max_size=4))
def test_alignment_of_any_text(aligner, parts):
    texts = [a + b + a for a, b in parts] + [None, "", "▁"]
    for text, (numbers, pairs, times, shown) in zip(texts, aligner.documents(texts)):
        n_a, n_b, n_groups, groups, links = plain_alignment(aligner, text)
        assert (numbers, shown) == ([n_a, n_b, n_groups, sum(links.values())], groups)
        assert dict(zip(pairs.tolist(), times.tolist())) == {a << 32 | b: n for (a, b), n in links.items()}


def test_alignment_of_long_runs(aligner):
    random.seed(7)
    texts = ["a" * 4001, "ab" * 2000, "nd" * 2500, " " * 3001, "=" * 997, "\n" * 300, "日本語" * 500, "".join(random.choices("aeinorst", k=5000)), "word, " * 9000]
    for text, (numbers, _, _, shown) in zip(texts, aligner.documents(texts)):
        want = plain_alignment(aligner, text)
        assert (numbers[:3], numbers[3], shown) == (list(want[:3]), sum(want[4].values()), want[3])


@settings(max_examples=200, deadline=None)
@given(a=st.sets(st.integers(1, 400), max_size=200), b=st.sets(st.integers(1, 400), max_size=200), far=st.integers(401, 2000))
def test_shared_cuts(a, b, far):
    x, y = np.array(sorted(a | {far})), np.array(sorted(b | {far}))
    at_x, at_y = alignment.shared_cuts(x, y)
    assert x[at_x].tolist() == y[at_y].tolist() == sorted((a & b) | {far})


def test_shared_cuts_far_apart():
    x, y = np.r_[np.arange(0, 4000, 2), 9000, 9001], np.r_[np.arange(1, 4001, 2), 9000, 9001]
    assert x[alignment.shared_cuts(x, y)[0]].tolist() == [9000, 9001]


def test_alignment_query(aligner, odd, empty, rows, monkeypatch):
    plain = [(i, plain_alignment(aligner, t)) for i, t in ODD]
    held = Counter(pair for _, p in plain for pair in p[4])
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    want = [
        (i, n_a, n_b, n_groups, sum(links.values()), sum(n for p, n in links.items() if held[p] == best[p[0]]),
         sum(n * held[p] for p, n in links.items()), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for i, (n_a, n_b, n_groups, groups, links) in plain
    ]
    assert rows(alignment.alignment_report(odd)) == sorted(want, key=repr)
    monkeypatch.setattr(alignment.aligned_blocks, "__defaults__", (*alignment.aligned_blocks.__defaults__[:2], 10))
    assert rows(alignment.alignment_report(odd.repartition(3))) == sorted(want, key=repr)  # a block a document
    assert alignment.alignment_report(empty).count() == 0
    shown = Counter((r.doc_id, r.groups) for r in alignment.with_groups(odd.select("doc_id", "text")).collect())
    assert shown == Counter((i, p[3]) for i, p in plain)


def test_first_fit_decreasing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 500):
        lengths = rng.integers(1, 100, n)
        bins, filled = packing.first_fit_decreasing(lengths, 100)
        free: list[int] = []
        want = np.zeros(n, int)
        for i in np.argsort(-lengths, kind="stable"):
            b = next((b for b, room in enumerate(free) if room >= lengths[i]), len(free))
            free += [100] * (b == len(free))
            free[b] -= lengths[i]
            want[i] = b
        assert bins.tolist() == want.tolist() and filled.tolist() == [100 - f for f in free]
        parts = defaultdict(list)
        sequences = defaultdict(list)
        for piece, cut, length, b, offset in packing.refill(lengths, bins, filled, 100):
            parts[piece].append((cut, length))
            sequences[b].append((offset, length))
        for whole, pieces in ((lengths, parts), (None, sequences)):
            for k, spans in pieces.items():
                spans.sort()
                assert [s for s, _ in spans] == [0, *np.cumsum([m for _, m in spans])[:-1]]
                total = sum(m for _, m in spans)
                assert total == whole[k] if whole is not None else total <= 100
        assert len(parts) == n


def check_packing(items, found, sequences):
    ids = lambda t: WORDS[False].encode(t or "", add_special_tokens=False).ids + [2]
    want = Counter((i, tuple(ids(t))) for i, t in items)
    by_sequence, spans = defaultdict(list), defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        spans[r.doc_id].append((r.start, r.length, r.doc_tokens, r.ids_crc32))
    texts = {s.sequence_id: np.frombuffer(s.ids, "<u4").tolist() for s in sequences}
    padded = 0
    for k, parts in by_sequence.items():
        parts.sort()
        n = sum(m for _, m in parts)
        assert [o for o, _ in parts] == [0, *np.cumsum([m for _, m in parts])[:-1]] and n <= 4096
        size = n if n & (n - 1) == 0 else 4096
        assert len(texts[k]) == size and set(texts[k][n:]) <= {0}
        padded += size - n
    for r in found:
        part = texts[r.sequence_id][r.offset : r.offset + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for i, group in spans.items():
        whole = [list(t) for (j, t), n in want.items() if j == i for _ in range(n)]
        assert sum(m for _, m, _, _ in group) == sum(map(len, whole))
        for start, m, total, crc in group:
            assert any(len(w) == total and zlib.crc32(np.array(w[start : start + m], "<u4").tobytes()) == crc for w in whole)
    return padded


def test_packing_query(docs, odd, empty, spark):
    from pyspark.sql import functions as F

    random.seed(3)
    items = [(i, " ".join(random.choices(["tree", "house", "runs", "12", "été"], k=random.randint(0, 6000)))) for i in range(60)]
    for source, given_ in ((odd, ODD), (docs(items), items)):
        pieces = packing.pieces_of(source)
        for size in (50_000, 5):  # one group and many
            parts = packing.packed(pieces, packing.placed(pieces, group_pieces=size))
            found = parts.withColumn("ids_crc32", F.crc32("ids")).collect()
            padded = check_packing(given_, found, packing.sequences(parts).collect())
            assert size < 1000 or padded < 0.02 * sum(r.length for r in found)
    assert packing.packing_report(empty).count() == 0


VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    T.StructField("n", T.StringType()), T.StructField("x", T.StringType()), T.StructField("v", T.StringType()),
])


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", "clash", "clash") for i, v in rows], VECTORS)


def compare_whitening(df, rows, count=8):
    kept = [(i, np.array(v, np.float32)) for i, v in rows]
    x = np.floor(1024 * np.stack([v for _, v in kept]).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x.astype(object) - s) ** 2).sum(axis=1)
    c = x - s / n
    cov = c.T @ c / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:count], basis[:, ::-1][:, :count]
    found = whitening.whitened(df).collect()
    assert len(found) == n * len(values) and {r.n for r in found} == {n}
    assert sorted((r.vec_id or -1, r.deviation) for r in found if r.component == 1) == sorted((i or -1, int(d)) for (i, _), d in zip(kept, deviation))
    for k, (value, direction) in enumerate(zip(values, basis.T)):
        own = [r for r in found if r.component == k + 1]
        assert all(math.isclose(r.explained, value / np.trace(cov), rel_tol=1e-6, abs_tol=1e-12) for r in own)
        if value > 1e-9 * values[0]:
            got = np.sort([r.whitened for r in own])
            want = np.sort(c @ direction / np.sqrt(value))
            assert min(np.abs(got - want).max(), np.abs(got + want[::-1]).max()) < 1e-6
        else:
            assert all(r.whitened is None for r in own)
    return found


def test_whitening_query(spark):
    rng = np.random.default_rng(5)
    good = [(i, (rng.normal(size=20) * np.arange(1, 21) / 10).tolist()) for i in range(300)]
    good += [(7, good[7][1]), (None, good[8][1])] + [(1000 + i, good[3][1]) for i in range(150)]  # repeated ids and a hot vector
    bad = [(1, None), (2, []), (3, [1.0] * 19), (4, [float("nan")] * 20), (5, [None] + [1.0] * 19), (6, [float("inf")] + [0.0] * 19)]
    for parts in (1, 40):  # with 40, triangles are folded in two rounds
        found = compare_whitening(vectors(spark, good + bad).repartition(parts), good)
        assert max(r.identity_error for r in found) < 1e-9


def test_whitening_odd_tables(spark):
    assert whitening.whitened(vectors(spark, [])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, None)])).count() == 0
    same = whitening.whitened(vectors(spark, [(i, [1.0, 2.0]) for i in range(3)])).collect()
    assert {(r.whitened, r.identity_error, r.deviation) for r in same} == {(None, None, 0)} and len(same) == 6
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)]  # one direction only
    found = compare_whitening(vectors(spark, rows), rows)
    assert max(r.identity_error for r in found) < 1e-9


@pytest.mark.parametrize("r", [
    np.eye(12), np.diag([5.0, 5, 5, 3, 3, 2, 2, 1]), np.zeros((9, 9)),
    np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20), 1), np.diag(10.0 ** -np.arange(12)) @ np.triu(np.ones((12, 12))),
    np.triu(np.random.default_rng(6).normal(size=(60, 60))),
])
def test_small_matrix(r):
    values, found = whitening.components(r, 8)
    singular = np.linalg.svd(r, compute_uv=False)
    assert np.abs(np.sqrt(values) - singular).max() <= 1e-13 * max(1, singular[0])
    k = found.shape[1]
    assert np.abs(found.T @ found - np.eye(k)).max() < 1e-12
    assert np.abs(r.T @ (r @ found) - found * values[:k]).max() <= 1e-12 * max(1, singular[0] ** 2)
