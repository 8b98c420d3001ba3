"""Posting lists as bytes of steps: as the lists they were made of, small, and searched without shuffling passages."""

import os
import random

import pyarrow as pa
import pytest

from sievework.operators import corpus, passages
from tests.conftest import rows


def batch_of(texts):
    return pa.RecordBatch.from_arrays([pa.array(list(texts), pa.int64()), pa.array([t.encode() for t in texts.values()], pa.binary())], ["passage", "text"])


def held_by(texts):
    padded = {i: t + "\0\0" for i, t in texts.items()}
    return sorted({(padded[i][k : k + 3], i) for i, t in texts.items() for k in range(len(t))})


@pytest.mark.parametrize("bits", [3, 14])
def test_steps_are_the_lists(monkeypatch, bits):
    monkeypatch.setattr(passages, "PIECE", 5_000)
    monkeypatch.setattr(passages, "BLOCK_BITS", bits)
    rng = random.Random(bits)
    numbers = [*rng.sample(range(40_000), 300), *range(1 << 33, (1 << 33) + 300), 16_383 + (5 << 40), 16_384 + (5 << 40)]
    texts = {i: "".join(rng.choices("abé日\0😀 ", k=rng.randint(0, 40))) for i in numbers}
    found = []
    for b in passages._steps(iter([batch_of(texts)])):
        asked = pa.RecordBatch.from_arrays([b["gram"], b["block"], pa.array([1] * len(b)), pa.array([[x] for x in b["steps"].to_pylist()])], ["word", "block", "need", "steps"])
        found += [(r["word"], r["passage"]) for n in passages._holders(iter([asked])) for r in n.to_pylist()]
    assert sorted(found) == held_by(texts)


def test_lists_that_meet():
    a, b, c = [0, 5, 300, 16_383], [5, 16_383], [4, 5]
    lists = [x.as_py() for some in (a, b, c) for n in passages._steps(iter([batch_of({i: "x" for i in some})])) for x in n["steps"]]
    asked = pa.RecordBatch.from_arrays([pa.array(["x"] * 3), pa.array([0, 2, 2]), pa.array([3, 2, 1]), pa.array([lists] * 3)], ["word", "block", "need", "steps"])
    first = 2 << passages.BLOCK_BITS
    assert [n["passage"].to_pylist() for n in passages._holders(iter([asked]))] == [[5], [first + 5, first + 16_383], [first + i for i in (0, 4, 5, 300, 16_383)]]


def test_more_letters_than_a_number_holds():
    points = [chr(p) for p in range(0x20, 0x50000) if not 0xD800 <= p < 0xE000]
    texts = {i: "".join(points[i * 3_000 : (i + 1) * 3_000]) for i in range(100)}
    found = [r for b in passages._lists(iter([batch_of(texts)])) for r in b.to_pylist()]
    assert sorted((r["gram"], p) for r in found for p in r["passages"]) == held_by(texts)


def test_a_posting_takes_less_than_a_byte(spark, tmp_path):
    rng = random.Random(1)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(500)]
    texts = {i: " ".join(rng.choices(words, k=40)) for i in range(6_000)}
    df = spark.createDataFrame([(i, 0, t) for i, t in texts.items()], "doc_id long, chunk_no int, chunk string").coalesce(1)
    passages.build(df, str(tmp_path / "index"))
    size = {kind: sum(f.stat().st_size for f in os.scandir(tmp_path / "index" / kind) if f.name.endswith(".parquet")) for kind in ("passages", "postings")}
    assert size["postings"] < len(held_by(texts))
    assert size["passages"] < sum(map(len, texts.values())) / 2


QUERIES = {"long": ["abca", "CAB", "dd"], "short": ["a", ""], "none": [], "absent": ["zzzz"]}


def test_passages_are_not_shuffled(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    data = [(d, c, "".join(rng.choices("abcd \n", k=rng.randint(0, 40)))) for d in range(60) for c in range(rng.randint(0, 3))]
    df = spark.createDataFrame(data, "doc_id long, chunk_no int, chunk string").repartition(4)
    passages.build(df, str(tmp_path / "index"))
    plans, keep = [], passages.written
    monkeypatch.setattr(passages, "written", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, label))
    monkeypatch.setattr(passages, "BROADCAST_ROWS", 30, raising=False)
    # Else a small table is broadcast in any case.
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = rows(passages.search(spark, str(tmp_path / "index"), QUERIES, 4).select("query", "score", "doc_id", "chunk_no", "chunk", "place"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert found == rows(corpus.top_k(df, QUERIES, 4).select("query", "score", "doc_id", "chunk_no", "chunk", "place"))
    joins = [p for p in plans if "chunk" in p]
    assert all("SortMergeJoin" not in p and "BroadcastHashJoin" in p for p in joins) and len(joins) > 2


@pytest.mark.parametrize("queries", [{"q": ["b"], "none": []}, {"none": []}])
def test_short_words_or_none(spark, tmp_path, queries):
    df = spark.createDataFrame([(1, 0, "abab"), (2, 0, "b"), (3, 0, "xyz"), (3, 1, None)], "doc_id long, chunk_no int, chunk string")
    passages.build(df, str(tmp_path / "index"))
    columns = ["query", "score", "doc_id", "chunk_no", "chunk", "place"]
    assert rows(passages.search(spark, str(tmp_path / "index"), queries, 3).select(columns)) == rows(corpus.top_k(df, queries, 3).select(columns))
