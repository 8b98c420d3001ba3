"""Runs against all periods of all stretches, and tiles of every size against each other."""

import random

import numpy as np
import pytest

from sievework.llm import periodic
from sievework.llm.queries import with_periods
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, mark string, runs int, period string"


def plain(words):
    """(start, length, period) of all runs: each maximal stretch of each period, smallest period only."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1 if n >= 4 else 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            stretch = words[i : i + length]
            if length >= max(6, 4 * q) and not any(all(stretch[x] == stretch[x + d] for x in range(length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs))


def repetitive(rng, n):
    """Words with nested, neighbouring and broken repetitions."""
    words = []
    while len(words) < n:
        kind = rng.random()
        block = rng.choices("abcdefgh" if kind < 0.7 else "ab", k=rng.choice([1, 1, 2, 3, 4, 5, 7, 8, 13, 16, 21, 40]))
        if kind < 0.2:
            block = block * 4 + ["x"]
        words += (block * rng.randint(1, 9))[: rng.randint(1, 300)]
        if rng.random() < 0.4:
            words += [f"w{rng.random():.3f}" for _ in range(rng.randint(1, 9))]
    return words[:n]


def texts(rng, n):
    out = ["", None, " \n", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "a b a b a b a", "\x0b".join("ab" * 50), "é é\té é é é É", "a\xa0a a\xa0a"]
    out += ["a " * 3_000, "a b " * 1_500, ("a " * 40 + "b ") * 60]
    return out + [" ".join(repetitive(rng, rng.randint(1, 700))) for _ in range(n)]


@pytest.mark.parametrize("long_bytes,tile", [(periodic.LONG_BYTES, periodic.TILE), (200, 16), (0, 64), (1000, 256)])
def test_all_runs(spark, long_bytes, tile):
    rng = random.Random(tile)
    rows = [(i - 3, t, "m", 1, "p") for i, t in enumerate(texts(rng, 60))]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id: r for r in periodic.with_runs(docs, long_bytes, tile).collect()}
    assert len(got) == len(rows)
    met = set()
    for doc, text, *_ in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        want = plain(words)
        r = got[doc]
        assert [tuple(x) for x in r.runs] == want and r.n_words == len(words)
        best = max(want, key=lambda x: (x[1] / x[2], -x[0], -x[2])) if want else None
        assert (r.strongest and tuple(r.strongest)) == best
        if len(words) < 800:
            assert r.collapsed == plain_collapsed(words, want)
        met |= {q.bit_length() for _, _, q in want}
    assert met >= {1, 2, 3, 4, 5}


def test_repeated_missing_ids_and_empty_table(spark):
    rows = [(1, "a " * 9), (1, "a " * 9), (1, "b c " * 9), (None, "d " * 7), (None, None), (2, "")]
    got = periodic.with_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.collapsed, len(r.runs)) for r in got) == [(0, "", 0), (0, "d", 1), (1, "a", 1), (1, "a", 1), (1, "b c", 1), (2, "", 0)]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.with_runs(none).collect() == [] and periodic.runs(none).collect() == []


def test_very_long_text(spark):
    """Octaves far beyond the shared tile rows."""
    rng = random.Random(5)
    block = [f"w{rng.randrange(4000)}" for _ in range(9_001)]
    words = ["lead"] * 5 + (block * 6)[:50_000] + ["tail", "tail"]
    got = periodic.runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), long_bytes=1000, tile=1024).collect()
    assert [(r.start, r.length, r.period) for r in got if r.period == 9_001] == [(5, 50_000, 9_001)]
    assert all(r.period < 100 or r.period == 9_001 for r in got)


@pytest.mark.parametrize("seed", range(4))
def test_z_function(seed):
    rng = random.Random(seed)
    s = rng.choices([1, 2], k=60)
    z = periodic.z_function(s, 60)
    for i in range(1, 60):
        k = 0
        while i + k < 60 and s[k] == s[i + k]:
            k += 1
        assert z[i] == k


def test_words_in_pieces(monkeypatch):
    monkeypatch.setattr(periodic, "PIECE", 3)
    text = b"ab cdefghij a\tab  x " * 4
    n = periodic.Numbers()
    ids = n.of(text)
    names = {v: k for k, v in n.table.items()}
    assert [names[i] for i in ids.tolist()] == text.split() and ids.dtype == np.int32


def test_periods_put_into_texts(spark):
    import zlib

    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices("abcdefghijklm", k=rng.randint(0, 60)))) for i in range(400)] + [(None, "a b c"), (7, None)]
    got = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", with_periods(F.col("text"), F.col("doc_id")).alias("new")).collect()
    changed = 0
    for doc, text, new in got:
        words = (text or "").split()
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        assert (new or "").split() == words
    assert changed > 20


def test_query(spark, sf_dir):
    """Every row of the registered query from a plain reading of the table."""
    import hashlib
    import zlib

    from sievework.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d in docs:
        words = [w.decode() for w in (d.text or "").encode().split()]
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = words[:a] + [words[a + i % p] for i in range(n - a)]
        runs = plain(words)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2])) if runs else (None,) * 3
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *best, best[1] * 1000 // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r.collapsed_sha256 == sha(plain_collapsed(words, runs))
