"""Exact and near deduplication against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sightlake.llm import exact_dedup, simhash

from .conftest import ODD

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def groups_of(items):
    found = {}
    for i, t in items:
        found.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    return found


@pytest.mark.parametrize("key", [F.xxhash64, lambda c: F.xxhash64(c) % 3, lambda c: F.lit(7).cast("long")])
@pytest.mark.parametrize("capacity", [65_536, 2])
def test_groups(odd, key, capacity):
    got = exact_dedup.duplicates(odd, capacity=capacity, key=key).collect()
    assert len(got) == len(ODD)
    groups = groups_of(ODD)
    by_sha = {hashlib.sha256(norm.encode()).hexdigest(): ids for norm, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert (r.keep_id, r.group_size) == (min(known, default=None), len(ids))
    for sha, ids in by_sha.items():  # one row of each group stays, the smallest
        kept = [r.doc_id for r in got if r.kept and r.text_sha256 == sha]
        assert kept == [min((i for i in ids if i is not None), default=None)]


def test_directory_doubles(spark, docs):
    index = exact_dedup.write_index(docs([(i, f"text {i % 500}") for i in range(3000)]), "doc_id", "text", 40)
    sizes = index.groupBy("bucket", "depth").agg(F.count("*").alias("n"), F.countDistinct("key").alias("k")).collect()
    assert len(sizes) > 60 and all(r.n <= 40 or r.k == 1 for r in sizes)
    assert index.count() == 3000


def test_deep_directory(spark, docs):
    """Keys that share their leading bits continue in the next level."""
    close = lambda c: F.xxhash64(c).bitwiseAND(F.lit(0xFFFF))
    index = exact_dedup.write_index(docs([(i, f"text {i}") for i in range(300)]), "doc_id", "text", 20, close)
    sizes = index.groupBy("bucket", "depth").count().collect()
    assert max(r["count"] for r in sizes) <= 20 and index.count() == 300


def test_keep_first(odd, empty, docs):
    left = exact_dedup.keep_first(odd)
    assert set(left.columns) == set(odd.columns)
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    want = []
    for norm, ids in groups_of(ODD).items():
        keep = min((i for i in ids if i is not None), default=None)
        want.append((keep, norm))
    assert sorted(((i, SPACE.sub(" ", t or "")) for i, t in got), key=repr) == sorted(want, key=repr)
    assert exact_dedup.keep_first(empty).count() == 0
    assert exact_dedup.duplicates(empty).count() == 0
    same_id = docs([(1, "a"), (1, "b"), (2, "b"), (3, "a")])
    assert sorted((r.doc_id, r.text) for r in exact_dedup.keep_first(same_id).collect()) == [(1, "a"), (1, "b")]


def fingerprint(text):
    words = [w for w in SPACE.split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_ids(prints, ids):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(prints))]


def test_near_duplicates(odd, empty, rows):
    prints = [fingerprint(t) for _, t in ODD]
    want = [(i, format(p, "016x"), c) for (i, _), p, c in zip(ODD, prints, component_ids(prints, [i for i, _ in ODD]))]
    assert rows(simhash.near_duplicates(odd)) == sorted(want, key=repr)
    assert simhash.near_duplicates(empty).count() == 0
    left = simhash.keep_one(odd)
    assert left.columns == odd.columns
    lost = {i for i, _, c in want if i is not None and i != c}
    assert sorted(repr(r.doc_id) for r in left.collect()) == sorted(repr(i) for i, _ in ODD if i not in lost)


@pytest.mark.parametrize("limit", [50_000, 3])
def test_links_in_dense_balls(spark, limit):
    random.seed(5)
    centres = [random.getrandbits(64) for _ in range(6)]
    near = {c ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 8))) for c in centres for _ in range(40)}
    prints = sorted(near | {0, 1, 7, 2**64 - 1})
    signed = [p - (p >> 63 << 64) for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = simhash.links(df, limit)
    pairs = [tuple(r) for r in links.collect()]
    assert all(0 < ((a ^ b) % 2**64).bit_count() <= 3 for a, b in pairs)
    assert len(pairs) < len(prints) ** 2 / 8  # stars, not all pairs
    found = {r.node: r.root for r in simhash.components(links).collect()}
    assert [found.get(p, p) for p in signed] == component_ids(prints, signed)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    found = dict(tuple(r) for r in simhash.components(edges).collect())
    assert found == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert np.all([simhash.simhash(t.encode()) == fingerprint(t) for t in ("", "A", "a B c d", "x y")])
