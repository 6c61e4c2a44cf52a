"""Language identification with character language models.

Method: one interpolated Kneser-Ney model per language over the characters of words (runs of
letters, lower-cased, with a start mark and an end). Counts are aggregated in Spark over a
bounded, documented sample: the ``sample_rows`` labelled rows of each language with the smallest
hash of their id. Every fifth of them calibrates instead: the temperature of the score, and per
language the highest length-normalised cross-entropy that is still accepted.

The models lie in one sorted array of n-gram hashes with a column per language (log probability
and back-off weight), so one binary search serves all languages. A text's score is the sum over
its words; frequent words come from a bounded cache. The language with the lowest cross-entropy
per character wins.

Sizes: n-grams are those of at most sample_rows texts per language, of at most
``MAX_LANGUAGES`` languages (more raise an error instead of being dropped).

Defined results: NULL text or no letter gives ``und`` with score 0, rejected; ties go to the
alphabetically first language; without labelled rows everything is ``und``; a NULL id counts as
the empty text in the split; extra columns stay.
"""

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sightlake.session import materialize

from .common import WordCache, crc_of_id, plain_name, share, shared_value, text_of, windows

ORDER = 5
SAMPLE_ROWS = 1000
MAX_LANGUAGES = 200
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
START, END = "^", "$"  # no letters, so never part of a word
WORD = re.compile(r"[^\W\d_]+").findall
SLACK = 1.6  # accepted cross-entropy over the calibration rows' highest


def held_out(doc_id: str = "doc_id") -> Column:
    return crc_of_id(doc_id) % FOLDS == HELD_OUT


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` rows per language: lang, text, calibrates."""
    # chosen by (id, text) hashes alone, so that no other text is shuffled
    known = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("doc_id", "text").alias("_key"))
    order = Window.partitionBy("lang").orderBy("_key")
    keys = known.select("lang", "_key").distinct().withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= rows)
    chosen = known.join(F.broadcast(keys), ["lang", "_key"]).dropDuplicates(["lang", "_key"])  # at most rows * MAX_LANGUAGES keys
    return chosen.select("lang", "text", (F.col("_n") % 5 == 0).alias("calibrates"))


def ngram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): n-grams of all orders of marked words, counted over all texts."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for piece in windows(text):
                    words[lang].update(WORD(piece.lower()))
        for lang, found in words.items():
            grams: Counter = Counter()
            for word, n in found.items():
                marked = START + word + END
                for i in range(1, len(marked)):
                    for k in range(1, min(order, i + 1) + 1):
                        grams[marked[i + 1 - k : i + 1]] += n
            items = list(grams.items())
            for i in range(0, len(items), 50_000):
                part = items[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array([g for g, _ in part]), pa.array([n for _, n in part], pa.int64())], schema=schema
                )

    partial = texts.select("lang", "text").mapInArrow(count, "lang string, gram string, n long")
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def gram_hash(symbols: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the ``k`` symbols that end at each position."""
    out = np.full(len(at), k, np.uint64)
    for i in range(k):
        out = (out ^ symbols[at - (k - 1 - i)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def kneser_ney(grams: dict[str, int], order: int) -> tuple[dict[str, float], dict[str, float]]:
    """(probability of each gram's last symbol after its others, back-off weight of each context).

    The highest order, and grams that begin with the start mark, use counts; lower orders use
    numbers of distinct left neighbours."""
    levels: list[dict[str, int]] = [{} for _ in range(order + 1)]
    left: list[Counter] = [Counter() for _ in range(order + 1)]
    for gram, n in grams.items():
        levels[len(gram)][gram] = n
        if len(gram) > 1:
            left[len(gram) - 1][gram[1:]] += 1
    for k in range(1, order):
        levels[k] = {g: (n if g[0] == START else max(left[k][g], 1)) for g, n in levels[k].items()}
    levels[1].pop(START, None)
    probability: dict[str, float] = {}
    weight: dict[str, float] = {}
    total = sum(levels[1].values())
    floor = 1.0 / (len(levels[1]) + 1)  # any other symbol
    for k in range(1, order + 1):
        once = sum(n == 1 for n in levels[k].values())
        twice = sum(n == 2 for n in levels[k].values())
        discount = once / (once + 2 * twice) if once and twice else 0.5
        sums: Counter = Counter()
        kinds: Counter = Counter()
        for gram, n in levels[k].items():
            sums[gram[:-1]] += n
            kinds[gram[:-1]] += 1
        for context, n in sums.items():
            weight[context] = discount * kinds[context] / n
        for gram, n in levels[k].items():
            context = gram[:-1]
            lower = floor if k == 1 else probability.get(gram[1:], weight.get("", 1.0) * floor)
            probability[gram] = (n - discount) / sums[context] + weight[context] * lower
    weight.setdefault("", 1.0)
    if not total:
        weight[""] = 1.0
    return probability, weight


@dataclass
class Models:
    """Sorted hash arrays: one row per gram and context, one column per language."""

    languages: list[str]
    order: int
    grams: np.ndarray
    log_p: np.ndarray
    contexts: np.ndarray
    log_w: np.ndarray
    floor: np.ndarray
    temperature: float = 1.0
    highest: np.ndarray | None = None

    def _find(self, table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def words(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        joined = "".join(START + w + END for w in words)
        symbols = _codes(joined)
        length = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), length)
        place = np.arange(len(symbols)) - np.repeat(np.cumsum(length) - length, length)
        at = np.flatnonzero(place > 0)  # the start mark itself is given
        out = np.zeros((len(at), len(self.languages)), np.float32)
        todo, k = np.arange(len(at)), self.order
        while k >= 1:
            now = todo[place[at[todo]] + 1 >= k]
            if len(now):
                row, hit = self._find(self.grams, gram_hash(symbols, at[now], k))
                out[now[hit]] += self.log_p[row[hit]]
                missed = now[~hit]
                if len(missed):
                    row, hit = self._find(self.contexts, gram_hash(symbols, at[missed] - 1, k - 1))
                    out[missed[hit]] += self.log_w[row[hit]]
                    if k == 1:
                        out[missed] += self.floor
                found = np.zeros(len(at), bool)
                found[now] = True
                found[missed] = False
                todo = todo[~found[todo]]
            k -= 1
        total = np.zeros((len(words), len(self.languages)), np.float64)
        np.add.at(total, owner[at], out)
        return total


def build_models(counts: dict[str, dict[str, int]], order: int = ORDER) -> Models:
    languages = sorted(counts)
    fitted = [kneser_ney(counts[lang], order) for lang in languages]
    floors = np.array([1.0 / (sum(len(g) == 1 and g != START for g in counts[lang]) + 1) for lang in languages])

    def table(names: list[str]) -> tuple[np.ndarray, list[str]]:
        keys = np.zeros(len(names), np.uint64)
        for k in range(order + 1):
            rows = [i for i, g in enumerate(names) if len(g) == k]
            if rows:
                symbols = _codes("".join(names[i] for i in rows)) if k else np.zeros(0, np.uint32)
                keys[rows] = gram_hash(symbols, np.arange(1, len(rows) + 1) * k - 1, k)
        by = np.argsort(keys)
        return keys[by], [names[i] for i in by]

    grams, names = table(sorted({g for p, _ in fitted for g in p}))
    contexts, context_names = table(sorted({c for _, w in fitted for c in w}))
    log_p = np.empty((len(names), len(languages)), np.float32)
    log_w = np.empty((len(context_names), len(languages)), np.float32)
    for column, (probability, weight) in enumerate(fitted):
        log_w[:, column] = [log(weight.get(c, 1.0)) for c in context_names]

        def of(gram: str) -> float:
            scale = 1.0
            while gram:
                if gram in probability:
                    return log(scale * probability[gram])
                scale *= weight.get(gram[:-1], 1.0)
                gram = gram[1:]
            return log(scale * floors[column])

        log_p[:, column] = [of(g) for g in names]
    return Models(languages, order, grams, log_p, contexts, log_w, np.log(floors).astype(np.float32))


class Scorer:
    def __init__(self, models: Models):
        self.models, self.cache = models, WordCache(150_000)

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, cross-entropy in nats per symbol and language) of whole texts."""
        cache = self.cache
        cache.trim()
        counted = []
        for text in texts:
            words: Counter = Counter()
            for piece in windows(text or ""):
                words.update(WORD(piece.lower()))
            counted.append(words)
        new = list(set().union(*counted).difference(cache)) if counted else []
        passing = {}
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            for word, scores in zip(part, map(tuple, self.models.words(part).tolist())):
                (cache if len(word) <= cache.longest else passing)[word] = scores
        symbols = np.zeros(len(texts), np.int64)
        out = np.zeros((len(texts), len(self.models.languages)))
        for i, words in enumerate(counted):
            if words:
                n = np.fromiter(words.values(), np.float64, len(words))
                rows = np.array([cache[w] if w in cache else passing[w] for w in words])
                symbols[i] = sum(words.values()) + sum(len(w) * k for w, k in words.items())
                out[i] = -(n @ rows) / symbols[i]
        return symbols, out


def fit(labelled: DataFrame, order: int = ORDER, sample_rows: int = SAMPLE_ROWS) -> Models:
    """Models of the languages in ``labelled`` (doc_id, lang, text), calibrated."""
    languages = labelled.filter("lang IS NOT NULL").select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if languages > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = materialize(sample(labelled, sample_rows), "language-sample").repartition(8)
    counts: dict[str, dict[str, int]] = {}
    for lang, gram, n in ngram_counts(rows.filter(~F.col("calibrates")), order).collect():
        counts.setdefault(lang, {})[gram] = n
    models = build_models(counts, order)
    if models.languages:
        _calibrate(models, rows.filter("calibrates"))
    return models


def _calibrate(models: Models, rows: DataFrame) -> None:
    """Temperature and highest accepted cross-entropy, from rows that the counts have not seen."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(models)
        for batch in batches:
            symbols, entropy = scorer.cross_entropy(batch.column(1).to_pylist())
            rows = entropy.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(symbols), pa.array(rows, pa.list_(pa.float64()))], names=["lang", "symbols", "entropy"])

    found = [r for r in rows.select("lang", "text").mapInArrow(score, "lang string, symbols long, entropy array<double>").collect() if r.symbols]
    at = {lang: i for i, lang in enumerate(models.languages)}
    models.highest = np.full(len(at), np.inf)
    entropy = np.array([r.entropy for r in found if r.lang in at]).reshape(-1, len(at))
    own = np.array([at[r.lang] for r in found if r.lang in at], np.int64)
    for i in range(len(at)):
        if (own == i).any():
            models.highest[i] = SLACK * entropy[own == i, i].max()
    best = None
    for t in (2.0, 4.0, 8.0, 16.0, 32.0):
        if len(own):
            z = -t * entropy
            fit_ = (z[np.arange(len(own)), own] - z.max(1) - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1))).mean()
            if best is None or fit_ > best:
                best, models.temperature = fit_, t


def with_language(df: DataFrame, models: Models, text: str = "text", out: str = "language") -> DataFrame:
    """``df`` with a struct: lang, score (0 to 1), cross_entropy (nats per character), rejected."""
    shared = share(df.sparkSession, models)  # bounded by the sample

    @F.arrow_udf("lang string, score double, cross_entropy double, rejected boolean")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared_value(shared)
        scorer = Scorer(model)
        for texts in batches:
            langs, scores, entropies, rejected = [], [], [], []
            if model.languages:
                symbols, entropy = scorer.cross_entropy(texts.to_pylist())
                best = entropy.argmin(1)
                z = -model.temperature * (entropy - entropy.min(1, keepdims=True))
                score = 1.0 / np.exp(z).sum(1)
            for i in range(len(texts)):
                known = bool(model.languages) and symbols[i] > 0
                langs.append(model.languages[best[i]] if known else UNKNOWN)
                scores.append(float(score[i]) if known else 0.0)
                entropies.append(float(entropy[i, best[i]]) if known else None)
                rejected.append(not known or bool(entropy[i, best[i]] > model.highest[best[i]]))
            yield pa.StructArray.from_arrays(
                [pa.array(langs), pa.array(scores, pa.float64()), pa.array(entropies, pa.float64()), pa.array(rejected)],
                ["lang", "score", "cross_entropy", "rejected"],
            )

    return df.withColumn(out, predict(text_of(text)))


def language_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; learns from rows that are not held out."""
    rows = docs.select("doc_id", "text", "lang")
    models = fit(rows.filter(~held_out()))
    found = with_language(docs.select("doc_id", "text"), models)
    return found.select(
        "doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"),
        F.col("language.cross_entropy").alias("cross_entropy"), F.col("language.rejected").alias("rejected"),
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that the models reject."""
    models = fit(docs.select("doc_id", "text", "lang").filter(~held_out()))
    out = plain_name(docs, "_language")
    return with_language(docs, models, out=out).filter(~F.col(f"{out}.rejected")).drop(out)
