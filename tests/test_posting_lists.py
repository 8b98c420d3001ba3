"""Posting lists are made inside the tasks, in pieces of passages."""

import random

import pyarrow as pa

from sievework.operators import passages


def test_lists_in_pieces(monkeypatch):
    monkeypatch.setattr(passages, "PIECE", 50)
    monkeypatch.setattr(passages, "BLOCK_BITS", 3)
    rng = random.Random(3)
    texts = {i: "".join(rng.choices("abé日\0😀 ", k=rng.randint(0, 25))) for i in rng.sample(range(60), 40)}
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, 99]), pa.array([*(t.encode() for t in texts.values()), None])], ["passage", "text"])
    found = [r for b in passages._lists(iter([batch])) for r in b.to_pylist()]
    assert all(p >> 3 == r["block"] for r in found for p in r["passages"])
    got = sorted((r["gram"], p) for r in found for p in r["passages"])
    padded = {i: t + "\0\0" for i, t in texts.items()}
    assert got == sorted({(padded[i][k : k + 3], i) for i, t in texts.items() for k in range(len(t))})
