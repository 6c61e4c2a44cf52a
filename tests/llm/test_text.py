"""Decontamination, chat rotation, language identification, language-model scores."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightlake.llm import chat, decontaminate as D, language_id as L, lm_score as S

from .conftest import ODD

LETTERS = "abcdefghijklmnopqrstuvwxyz "


def edits(pattern, text):
    """Least edits of the whole pattern inside the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def damaged(text, k, rng):
    chars = list(text)
    for _ in range(k):
        at, kind = rng.randrange(len(chars)), rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice(LETTERS)
        elif kind == 1:
            del chars[at]
        else:
            chars.insert(at, rng.choice(LETTERS))
    return "".join(chars)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    words = ["".join(rng.choices(LETTERS[:-1], k=rng.randint(2, 9))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, line(rng.randint(6, 40))) for i in range(12)] + [(90, None), (91, ""), (92, "short"), (None, line(12))]
    texts = []
    for i in range(60):
        text = line(80)
        if i % 3 == 0:
            item = items[i // 3 % 12][1]
            text = text[:200] + " " + damaged(item, int(len(item) * (0, 0.02, 0.05, 0.2)[i // 3 % 4]), rng) + "\n" + text[200:].upper()
        texts.append((i, text))
    return items, texts


def test_matches_equal_brute_force(spark, docs, corpus):
    items, texts = corpus
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: {m.item_id for m in r.matches} for r in D.with_matches(docs(texts), benchmark, block_chars=300).collect()}
    for i, text in texts:
        want = set()
        for item, raw in items:
            norm = D.normalise(raw)
            if len(norm) < D.MIN_CHARS:
                continue
            if any(edits(p, D.normalise(text)) <= D.edit_budget(len(p)) for p in D.pieces_of(norm)):
                want.add(item)
        assert got[i] == want, i


def test_parts_of_items_are_found():
    """Runs of 13 words from any word of an item on, verbatim or with an edit, in other prose."""
    rng = random.Random(11)
    line = lambda n: " ".join("".join(rng.choices(LETTERS[:-1], k=rng.randint(2, 9))) for _ in range(n))
    dense = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(n))
    items = [(i, line(rng.randint(18, 90))) for i in range(20)] + [(50, dense(300)), (51, "x" * 400 + line(20))]
    index = D.build_index(items)
    for i, text in items[:20]:
        words = text.split()
        for s in range(len(words) - 12):
            run = " ".join(words[s : s + 13])
            at = rng.randrange(len(run))
            quotes = [line(30) + " " + q + " " + line(30) for q in (run, run[:at] + "#" + run[at + 1 :])]
            exact, edited = D.find(index, quotes)
            assert exact == [(i, 0, quotes[0].index(run), quotes[0].index(run) + len(run))]
            assert [m[:2] for m in edited] == [(i, 1)]
    assert [m[:2] for m in D.find(index, [dense(90) + items[20][1][101:157] + dense(90)])[0]] == [(50, 0)]
    assert D.find(index, [line(30) + " " + " ".join(items[0][1].split()[:6]) + " " + line(30)]) == [[]]


def test_short_items_are_whole_words(spark, docs):
    benchmark = spark.createDataFrame([(1, "Blue  whale"), (2, "x=1;"), (3, "鯨は青い"), (4, "blue whale"), (5, " \n"), (6, "é"), (None, "end")], "item_id long, text string")
    texts = [
        (1, "The (blue\nwhale) sings."), (2, "a blue whales, ablue whale, blue-whale"), (3, "max=1;2"), (4, "then x=1;y=2 in the END"), (5, "大きな鯨は青いです"),
        (6, "ends ending bend é"), (7, None), (8, "éa aé"), (9, "blue whal\0e"), (10, "blue whales and a BLUE WHALE"),
    ]
    for size in (D.BLOCK_CHARS, 1):
        got = {r.doc_id: [(m.item_id, m.edits) for m in r.matches] for r in D.with_matches(docs(texts), benchmark, block_chars=size).collect()}
        want = {1: [1, 4], 4: [2, None], 5: [3], 6: [6], 10: [1, 4]}
        assert {i: sorted(m, key=repr) for i, m in got.items()} == {i: [(m, 0) for m in want.get(i, [])] for i, _ in texts}


def test_alignment(spark):
    rng = random.Random(3)
    for _ in range(200):
        pattern = "".join(rng.choices("abc", k=rng.randint(5, 30)))
        region = "".join(rng.choices("abc", k=4)) + damaged(pattern, rng.randint(0, 4), rng) + "".join(rng.choices("abc", k=5))
        cost, start, stop = D.align(D.codes(pattern), D.codes(region), -len(pattern), len(region), len(pattern))
        assert cost == edits(pattern, region)
        assert 0 <= start <= stop <= len(region)


def test_contamination_of_odd_rows(spark, odd, empty, rows):
    benchmark = spark.createDataFrame([(1, "THE cat sat on the mat and looked at the dog."), (2, None)], "item_id long, text string")
    got = rows(D.contamination(odd, benchmark).select("doc_id", "contaminated", "item_ids", "least_edits"))
    hit = [bool(t) and D.normalise(t).startswith("the cat sat") for _, t in ODD]
    assert got == sorted(((i, h, [1] if h else [], 0 if h else None) for (i, _), h in zip(ODD, hit)), key=repr)
    clean = D.keep_clean(odd, benchmark)
    assert clean.columns == odd.columns and clean.count() == len(ODD) - sum(hit)
    assert D.contamination(odd, benchmark.limit(0)).filter("contaminated").count() == 0
    assert D.contamination(empty, benchmark).count() == 0


def test_rotation(spark, rows):
    said = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob b", "yo <|turn|>assistant"), (1, 3, "ann", None), (1, 3, "ann", None),
        (1, None, None, "last"), (2, 0, "system", "alone"), (None, 5, "ann", "no id"),
    ]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("head", F.lit("clash")).withColumn("spans", F.lit(1))
    for size in (512, 1):
        got = {(r.conv_id, r.perspective): r for r in chat.rotations(df, size).collect()}
        assert set(got) == {(1, "ann"), (1, "bob b"), (1, "unknown"), (None, "ann")}
        bob = got[1, "bob b"]
        assert bob.rendered == (
            "<|turn|>system\nbe kind<|end|>\n<|turn|>user name=ann\nhi<|end|>\n<|turn|>assistant\nyo < |turn|>assistant<|end|>\n"
            "<|turn|>user name=ann\n<|end|>\n<|turn|>user name=ann\n<|end|>\n<|turn|>user name=unknown\nlast<|end|>\n"
        )
        assert [bob.rendered[s.start : s.stop] for s in bob.spans] == ["yo < |turn|>assistant<|end|>"]
        ann = got[1, "ann"]
        assert [ann.rendered[s.start : s.stop] for s in ann.spans] == ["hi<|end|>", "<|end|>", "<|end|>"]
        assert "user name=bob_b\n" in ann.rendered and ann.trained_chars == 23
    assert chat.rotations(df.limit(0)).count() == 0


def test_kneser_ney_is_a_distribution():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcd", k=rng.randint(1, 5))) for _ in range(300)]
    grams = Counter()
    for w in words:
        marked = L.START + w + L.END
        for i in range(1, len(marked)):
            for k in range(1, min(3, i + 1) + 1):
                grams[marked[i + 1 - k : i + 1]] += 1
    models = L.build_models({"xx": dict(grams)}, order=3)
    probability, weight = L.kneser_ney(dict(grams), 3)
    for context in ("", "a", "b", L.START, "ab", L.START + "c"):
        seen = sum(p for g, p in probability.items() if g[:-1] == context)
        rest = 0.0
        for c in "abcd" + L.END:
            if context + c not in probability:
                scale, g = 1.0, context + c
                while g and g not in probability:
                    scale, g = scale * weight.get(g[:-1], 1.0), g[1:]
                rest += scale * (probability[g] if g else 1 / 6)
        assert 0.9 < seen + rest <= 1.0 + 1e-9
    # the arrays give what the dictionaries say

    def plain(word):
        marked, total = L.START + word + L.END, 0.0
        for i in range(1, len(marked)):
            g, scale = marked[max(0, i - 2) : i + 1], 1.0
            while g and g not in probability:
                scale, g = scale * weight.get(g[:-1], 1.0), g[1:]
            total += math.log(scale * (probability[g] if g else float(np.exp(models.floor[0]))))
        return total

    tried = words[:50] + ["zzz", "azb", "q"]
    assert np.allclose(models.words(tried)[:, 0], [plain(w) for w in tried], atol=1e-3)


def test_languages(spark, docs, odd):
    rng = random.Random(2)
    sounds = {"aa": "ka to mi re su".split(), "bb": "sch ung ein ver lich".split(), "cc": "éau que ment oi tion".split()}
    make = lambda s, n: " ".join("".join(rng.choices(s, k=rng.randint(1, 4))) for _ in range(n))
    items = [(i, make(sounds[lang], 30), lang) for i, lang in enumerate(rng.choices(list(sounds), k=240))]
    junk = [(1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "жшщ цчх " * 20, None), (1003, make(sounds["bb"], 20), None)]
    got = {r.doc_id: r for r in L.language_report(docs(items + junk)).collect()}
    for i, _, lang in items:
        assert got[i].lang_pred == lang and 0 <= got[i].score <= 1
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert [got[i].lang_pred for i in (1000, 1001, 1003)] == ["und", "und", "bb"]
    assert [got[i].rejected for i in (1000, 1001, 1002, 1003)] == [True, True, True, False]
    kept = L.keep_identified(docs(items + junk).withColumn("_language", F.lit("clash")))
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in items} | {1003} and "_language" in kept.columns
    assert L.language_report(odd).count() == len(ODD)
    nothing = L.language_report(docs([(1, "text", None)])).first()
    assert (nothing.lang_pred, nothing.score, nothing.rejected) == ("und", 0.0, True)
    assert L.language_report(docs([])).count() == 0


def plain_scores(items, block_weights):
    """Counts, base scores and interpolated scores, document by document."""
    texts = [((t or "").encode().lower().split() + [None], i) for i, t in items]
    learns = [zlib.crc32((b"" if i is None else str(i).encode())) % 10 != 0 for _, i in texts]
    words, pairs = Counter(), Counter()
    for (w, _), on in zip(texts, learns):
        if on:
            words.update(w)
            pairs.update(zip([0, *w], w))
    n, v, starts = sum(words.values()), len(words), sum(learns)
    out = []
    for (w, i), on in zip(texts, learns):
        low = [(words[x] + 0.1) / (n + 0.1 * (v + 1)) for x in w]
        score = 0.0
        for before, x, p in zip([0, *w], w, low):
            context = starts if before == 0 else words[before]
            lam = block_weights[int(S.bucket_of(np.array([context]))[0])]
            score += math.log10(lam * pairs[before, x] / max(context, 1) + (1 - lam) * p)
        out.append((i, not on, len(w), sum(words[x] > 0 for x in w), n, sum(map(math.log10, low)), score))
    return out


@pytest.mark.parametrize("block_tokens", [1 << 21, 50])
def test_scores_equal_plain_counts(docs, odd, monkeypatch, block_tokens):
    rng = random.Random(4)
    common = ["the", "Of", "and", "to"] + [f"w{i}" for i in range(40)]
    items = ODD + [(i, " ".join(rng.choices(common, weights=[20, 10, 8, 6] + [1] * 40, k=rng.randint(0, 60)))) for i in range(100, 220)]
    learned = []
    real = S.learn_weights
    monkeypatch.setattr(S, "learn_weights", lambda cells: learned.append(real(cells)) or learned[-1])
    got = S.score_documents(docs(items), ~S.held_out(), block_tokens=block_tokens, part_keys=500)
    got = sorted(((r.doc_id, not r.train, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got.collect()), key=repr)
    want = sorted(plain_scores(items, learned[0]), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)
    assert sum(g[6] for g in got) > sum(g[5] for g in got)


def test_scores_of_little(docs, empty):
    assert S.corpus_scores(empty).count() == 0
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = S.corpus_scores(docs([(alone, "never learned")])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_weights_rise_with_useful_pairs():
    cell = lambda bucket, bin_: bucket * S.BINS + bin_
    useful = S.learn_weights([(cell(4, 400), 90.0, 90.0 * math.log(50)), (cell(4, 0), 10.0, 0.0)])
    useless = S.learn_weights([(cell(4, 0), 100.0, 0.0)])
    assert useful[4] > 0.8 and useless[4] < 0.02
