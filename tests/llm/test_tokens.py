"""Token counts, byte-level BPE and token files against the vocabularies' own libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from sightlake.llm import byte_bpe, token_counts, token_files
from sightlake.llm.common import windows

from .conftest import ODD

PIECES = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
BYTES = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
JSON = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def counter():
    return token_counts.PieceCounter(P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.ByteBpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def encoder():
    return token_files.CachedEncoder(P.path("byte_bpe_50k.json"))


TEXT = st.text(st.one_of(st.sampled_from(" \n\t  aeinorst▁<|>'s1é\x1c\x85　"), st.characters(exclude_categories=["Cs"])), max_size=80)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXT, max_size=4))
def test_any_text(counter, coder, encoder, texts):
    assert counter.count(texts) == [len(x) for x in PIECES.encode(texts)]
    packed = coder.encode(texts)
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == [BYTES.encode_ordinary(t) for t in texts]
    assert [coder.decode(p) for p in packed] == [t.encode() for t in texts]
    ids = [np.frombuffer(p, "<u4").tolist() for p in encoder.encode(texts)]
    assert ids == [e.ids for e in JSON.encode_batch(texts, add_special_tokens=False)]


def test_long_pretokens(counter, coder):
    random.seed(1)
    texts = ["a" * 5001, "ab" * 3000 + "a", "".join(random.choices("aeinorst", k=20_000)), " " * 5000 + "x", "=" * 4097]
    assert counter.count(texts) == [len(x) for x in PIECES.encode(texts)]
    assert [np.frombuffer(p, "<u4").tolist() for p in coder.encode(texts)] == [BYTES.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("pair", ["nd", "th", "a", "=-"])
def test_time_grows_with_length(counter, coder, pair):
    """Pairs whose merges are applied one by one, at two sizes: near-linear, and equal to the libraries."""
    import time

    took = []
    for n in (10_000, 80_000):
        text = pair * (n // len(pair))
        started = time.process_time()
        packed, total = coder.encode([text])[0], counter.count([text])[0]
        took.append(time.process_time() - started)
        assert total == len(PIECES.encode(text))
        if n <= 10_000:
            assert np.frombuffer(packed, "<u4").tolist() == BYTES.encode_ordinary(text)
    assert took[1] < 30 * took[0] + 1


def test_windows_keep_the_text():
    text = "ab  cd \n ef gh " * 50
    parts = list(windows(text, 40))
    assert "".join(parts) == text and len(parts) > 5
    assert list(windows("", 4)) == [""] and list(windows("x" * 99, 4)) == ["x" * 99]


def test_rank_queue_order():
    queue = byte_bpe.RankQueue(70_000)
    random.seed(2)
    ranks = random.sample(range(70_000), 500)
    for r in ranks:
        queue.push(r, r + 1)
    assert [queue.pop() for _ in ranks] == [(r, [r + 1]) for r in sorted(ranks)] and not queue.top


def test_count_query(odd, empty, rows):
    want = [(i, len((t or "").encode()), len(PIECES.encode(t or "")), len(PIECES.encode(t or "")) > 4096) for i, t in ODD]
    assert rows(token_counts.token_report(odd)) == sorted(want, key=repr)
    assert token_counts.token_report(empty).count() == 0


def test_round_trip_query(odd, empty, rows):
    def row(i, t):
        ids = BYTES.encode_ordinary(t or "")
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    assert rows(byte_bpe.round_trip(odd)) == sorted((row(i, t) for i, t in ODD), key=repr)
    assert byte_bpe.round_trip(empty).count() == 0
    back = byte_bpe.with_text(byte_bpe.with_ids(odd.select("doc_id", "text"))).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back)


def want_files(items):
    out, start = [], 0
    for i, t in sorted(items, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = JSON.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


def test_token_file_query(odd, empty, rows):
    assert rows(token_files.stored_documents(odd)) == want_files(ODD)
    assert token_files.stored_documents(empty).count() == 0


def test_small_files_and_random_access(docs, rows):
    items = [(i, f"document {i} " * (i % 7 + 1)) for i in range(200, 0, -1)]
    manifest = token_files.write_token_files(docs(items), file_ids=100)
    files = sorted(manifest.collect(), key=lambda r: (r.shard, r.seq))
    assert len(files) > 10
    found = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in token_files.read_token_files(manifest).collect()]
    assert sorted(found, key=repr) == want_files(items)
    f = token_files.TokenFile(files[0].path)
    whole = f.ids(0, len(f))
    assert [f[i] for i in range(len(f))] == whole.tolist()
    with pytest.raises(IndexError):
        f[len(f)]


@settings(max_examples=60, deadline=None)
@given(values=st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), min_size=1, max_size=2000), data=st.data())
def test_levels(tmp_path_factory, values, data):
    path = tmp_path_factory.mktemp("dac") / "x.dac"
    levels = token_files.ChunkLevels()
    levels.add(5, np.array(values, np.uint32))
    with open(path, "wb") as out:
        levels.write(out)
    f = token_files.TokenFile(str(path))
    a = data.draw(st.integers(0, len(values)))
    b = data.draw(st.integers(a, len(values)))
    assert f.ids(a, b).tolist() == values[a:b]
    assert f.documents()[0] == [5]
