"""Line keep bitmaps against a plain reading of the rule."""

import random

import numpy as np
import pytest

from sievework.llm import line_dedup

SCHEMA = "doc_id long, text string, keep string, mark int, lang string"


def plain(rows, least=10):
    """For each row (doc_id, text): the places of its lines that go."""
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    order = lambda i: line_dedup.LARGEST if i is None else i
    first = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            k = key(line)
            first[k] = min(first.get(k, line_dedup.LARGEST), order(doc))
    return [[i for i, line in enumerate((t or "").split("\n")) if len(key(line)) >= least and first[key(line)] != order(d)] for d, t in rows]


def texts(rng, n):
    lines = ["short", "a line of its own", " A LINE of its own\t", "ÉCOLE normale", "école normale", "", "  ", "123456789", "1234567890", "日本語の長い行です。。", "x" * 5000]
    return ["\n".join(rng.choices(lines + [f"only here {rng.random()}"], k=rng.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("partitions", [1, 5])
def test_against_plain_reading(spark, partitions):
    rng = random.Random(partitions)
    rows = [(i * 3, t) for i, t in enumerate(texts(rng, 120))] + [(10_000, None), (10_001, ""), (10_002, "a line of its own\r\nA line of its own"), (10_003, "\n\n")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "k", 1, "en") for r in rows], SCHEMA).repartition(partitions)
    want = dict(zip((r[0] for r in rows), plain(rows)))
    whole = dict(rows)
    got = line_dedup.with_keep(docs).collect()
    assert len(got) == len(rows) and any(want.values())
    for r in got:
        lines = (whole[r.doc_id] or "").split("\n")
        assert r.n_lines == len(lines) and r.n_dropped == len(want[r.doc_id])
        stays = line_dedup.decode(r.keep, r.n_lines) if r.keep else np.ones(r.n_lines, bool)
        assert np.flatnonzero(~stays).tolist() == want[r.doc_id]
    assert {r.doc_id: r.n_dropped for r in line_dedup.keep_bitmaps(docs).collect()} == {i: len(w) for i, w in want.items()}
    left = line_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    for r in left.collect():
        lines = (whole[r.doc_id] or "").split("\n")
        kept = "\n".join(x for i, x in enumerate(lines) if i not in want[r.doc_id])
        assert r.text == (kept if want[r.doc_id] else whole[r.doc_id]) and (r.keep, r.mark, r.lang) == ("k", 1, "en")


def test_one_line_in_every_range(spark):
    """One hash over many tasks: all but its first task begin with it."""
    rows = [(i, "the very same line\nthe very same line") for i in range(2_000)]
    got = {r.doc_id: r.n_dropped for r in line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert got == {i: 2 if i else 0 for i in range(2_000)}


def test_repeated_and_missing_ids(spark):
    rows = [(1, "first line here\nother line 1"), (1, "first line here\nother line 2"), (2, "first line here"), (2, "first line here"), (None, "other line 2\nnowhere else 1"), (None, "nowhere else 1"), (None, None)]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((-1 if d is None else d, len((t or "").split("\n")), len(p)) for (d, t), p in zip(rows, plain(rows)))


def test_empty_table_and_long_text(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.keep_bitmaps(none).collect() == [] and line_dedup.deduplicated(none).collect() == []
    many = "\n".join(f"line number {i % 50_000}" for i in range(100_000))
    got = {r.doc_id: r for r in line_dedup.with_keep(spark.createDataFrame([(1, "line number 7"), (2, many)], "doc_id long, text string")).collect()}
    assert (got[1].n_dropped, got[2].n_dropped, got[2].n_lines) == (0, 2, 100_000) and len(got[2].keep) < 20


@pytest.mark.parametrize("seed", range(8))
def test_bitmaps(seed):
    rng = random.Random(seed)
    lines = rng.choice([1, 9, 1_000, 40_000])
    gone = sorted(rng.sample(range(lines), rng.randint(0, lines)))
    written = line_dedup.encode(gone[::-1] + gone[:3])
    assert np.flatnonzero(~line_dedup.decode(written, lines)).tolist() == gone
    assert len(written) <= lines // 8 + 2
    assert len(line_dedup.encode(range(5, 30_000))) == 5
