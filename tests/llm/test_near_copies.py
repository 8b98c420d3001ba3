"""SimHash groups and pivot-index links against all pairs."""

import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sievework.llm import pivots, simhash

TEXTS = ["", None, " \t", "One", "one TWO", "a b c", "A b\nc", "É b c d", "é b c d", "x " * 20_000]


def plain_fingerprint(text, words=3):
    parts = [p for p in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if p]
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(values, linked):
    """Smallest index of each one's component, by brute force."""
    parent = list(range(len(values)))
    for a in range(len(values)):
        for b in range(a):
            if linked(values[a], values[b]):
                parent = [min(parent[a], parent[b]) if p in (parent[a], parent[b]) else p for p in parent]
    return parent


def test_fingerprints():
    rng = random.Random(3)
    texts = [t or "" for t in TEXTS] + [" ".join(rng.choices(["Aa", "b\x0bc", "d", "ü"], k=rng.randint(1, 40))) for _ in range(60)]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_groups(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    texts = list(TEXTS)
    for _ in range(12):
        base = rng.choices(words, k=400)
        for _ in range(4):
            base = list(base)
            base[rng.randrange(400)] = rng.choice(words)
            texts.append(" ".join(base))
    docs = spark.createDataFrame([(i + 5, t, 0, "k") for i, t in enumerate(texts)], "doc_id long, text string, fp int, component_id string")
    prints = [plain_fingerprint(t) for t in texts]
    want = groups_of(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    got = {r.doc_id - 5: r for r in simhash.grouped(docs).collect()}
    assert [got[i].component_id - 5 for i in range(len(texts))] == want
    assert [got[i].fp & ((1 << 64) - 1) for i in range(len(texts))] == prints
    assert len(set(want)) < len(set(prints))
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id - 5 for r in left.collect()) == sorted(set(want))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5])
def test_links_are_all_pairs_within_k(spark, k):
    rng = random.Random(k)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints):
        for _ in range(4):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, k + 2))))
    prints |= {0, (1 << 64) - 1, 1 << 63, 7}
    signed = sorted(simhash._signed(p) for p in prints)
    found = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), k).collect()}
    mask = (1 << 64) - 1
    assert found == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= k}


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, "q r s t"), (None, "q r s t"), (3, "m n o p"), (3, "w x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = simhash.grouped(docs)
    assert groups.count() == 8
    left = sorted(map(tuple, simhash.one_of_each(docs).collect()), key=str)
    assert left == sorted([(1, "a b c d"), (None, "q r s t"), (3, "m n o p"), (3, "w x y z")], key=str)
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def vectors():
    rng = np.random.default_rng(8)
    rows = []
    for size in (1, 2, 40, 90, 5):
        center = rng.normal(size=16)
        rows += [center + 0.08 * rng.normal(size=16) * np.linalg.norm(center) / 4 for _ in range(size)]
    rows += list(rng.normal(size=(150, 16)))
    return [r.tolist() for r in rows]


def test_vector_links(spark):
    rows = vectors()
    odd = [None, [], [0.0] * 16, [math.nan] + [1.0] * 15, [math.inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e-200] * 3, [1e200] * 3]
    everything = rows + rows[3:6] + odd
    df = spark.createDataFrame([(i, v, 0, "k") for i, v in enumerate(everything)], "vec_id long, embedding array<double>, n_links int, class string")

    def linked(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b:
            return False
        x, y = np.array(a) / np.abs(a).max(), np.array(b) / np.abs(b).max()
        return bool(np.isfinite(x).all() and np.isfinite(y).all() and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9)

    with np.errstate(all="ignore"):
        want = [sum(i != j and linked(a, b) for j, b in enumerate(everything)) for i, a in enumerate(everything)]
        parts = groups_of(everything, linked)
    got = {r.vec_id: r for r in pivots.near_duplicates(df, block=32).collect()}
    assert len(got) == len(everything)
    counted = [got[i].n_links for i in range(len(everything))]
    assert all(c <= w for c, w in zip(counted, want))
    assert sum(counted) >= 0.9 * sum(want)
    assert [got[i].component_id for i in range(len(everything))] == parts
    assert all(got[i].kept == (parts[i] == i) for i in range(len(everything)))


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, pivots.near_duplicates(df).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert pivots.near_duplicates(df.limit(0)).count() == 0


def test_blocks_count_each_pair_once(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors())], "vec_id long, embedding array<double>")
    a = {r.vec_id: r.n_links for r in pivots.near_duplicates(df, block=8, shared=1).collect()}
    b = {r.vec_id: r.n_links for r in pivots.near_duplicates(df, block=10_000, shared=1).collect()}
    assert a == b and df.where(F.col("vec_id") < 0).count() == 0


@pytest.mark.parametrize("least", [1024, 4096])
def test_links_near_the_threshold_are_found_with_many_pivots(spark, least):
    rng = np.random.default_rng(least)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a, z = unit(rng.normal(size=(1500, 64))), rng.normal(size=(1500, 64))
    z = unit(z - (z * a).sum(1, keepdims=True) * a)
    cosine = rng.uniform(0.901, 0.91, size=(1500, 1))
    rows = np.concatenate([a, cosine * a + np.sqrt(1 - cosine**2) * z, unit(rng.normal(size=(9000, 64)))])
    want = (a @ rows.T >= 0.9).sum(1) - 1
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in pivots.near_duplicates(df, least=least).where("vec_id < 3000").collect()}
    links = np.array([got[i].n_links for i in range(1500)])
    assert want.sum() >= 1500 and (links <= want).all()
    assert links.sum() >= 0.998 * want.sum()
    assert sum(got[1500 + i].component_id == i for i in range(1500)) >= 0.998 * 1500
