"""Source divergence against the formula, term by term, and the tree against a dense matrix."""

import random
import re

import numpy as np
import pytest

from sievework.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, row int"


def plain(rows, least=10, top=10):
    """(lang, source, part, item, value, rank) of rows (text, lang, source)."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t or "")), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        kept = [t for t in {t for w, _, _ in own for t in w} if sum(t in w for w, _, _ in own) >= least]
        counts = {s: {t: sum(w.count(t) for w, _, x in own if x == s) for t in kept} for s in {d[2] for d in own}}
        counts[None] = {t: sum(w.count(t) for w, _, _ in own) for t in kept}
        share = {s: {t: 1 + 10**9 * (c + 2) // (sum(n.values()) + 2 * len(kept)) for t, c in n.items()} for s, n in counts.items()}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in counts.keys() - {None}:
            pair = [(x, sum(f(share[s][t], share[x][t]) for t in kept)) for x in counts.keys() - {None, s}]
            term = [(t, f(share[s][t], share[None][t])) for t in kept if counts[s][t] and share[s][t] > share[None][t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def made(rng, n, sources, words):
    zipf = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for _ in range(n):
        source = rng.choice(sources)
        own = words[hash(source) % 7 :: 2] if source else words
        rows.append((" ".join(rng.choices(own, zipf[: len(own)], k=rng.randint(0, 30))), rng.choice(["en", "en", None, "é"]), source))
    return rows


@pytest.mark.parametrize("side,squares", [(64, 8), (4, 2), (2, 1)])
def test_against_formula(spark, monkeypatch, side, squares):
    """Small squares give many blocks of groups and strips of terms; the driver builds the plan, tasks read the module's sizes."""
    rng = random.Random(side)
    words = [f"{a}{b}" for a in "aBéÅ日z" for b in "opqrstuv"]
    rows = made(rng, 500, [*"abcdefghi", None], words) + [("", "xx", "lonely"), (None, "xx", ""), ("rare words only", "yy", "s")]
    docs = spark.createDataFrame([(i, t, lang, s, "x", 1) for i, (t, lang, s) in enumerate(rows)], SCHEMA).repartition(4)
    if (side, squares) == (64, 8):
        got = sorted(tuple(r) for r in divergence.audit(docs).collect())
        assert got == plain(rows)
        assert {r[0] for r in got} >= {"", "xx", "en", "é"} and any(r[4] == 0 for r in got)
        return
    monkeypatch.setattr(divergence, "SIDE", side)
    monkeypatch.setattr(divergence, "SQUARES", squares)
    # The units of work, cut with these sizes, walked here instead of in workers that hold other sizes.
    m = divergence.matrix(docs)
    cells = m.cells.toPandas()
    groups = m.groups.toPandas()
    want = {r[:2] + r[3:4]: r[4] for r in plain(rows) if r[2] == "pair"}
    for lang, own in groups.groupby("lang"):
        if own["v"].iloc[0] == 0:
            continue
        here, v = cells[cells["lang"] == lang], int(own["v"].iloc[0])
        own = own.sort_values("row")
        blocks = range(-(-len(own) // side))
        p0 = own["p0"].to_numpy(np.int64)
        for low in blocks:
            for high in blocks[low:]:
                sums = 0
                for square in range(-(-v // side)):
                    trees = []
                    for block in (low, high):
                        t = here[(here["row"] // side == block) & (here["col"] // side == square)]
                        trees.append(divergence.Tree(*(t[c].to_numpy(np.int64) % side for c in ("row", "col")), t["p"].to_numpy(np.int64)))
                    part = [p0[b * side : (b + 1) * side] for b in (low, high)]
                    sums = sums + divergence.walk(*trees, *part, min(side, v - square * side), low == high)
                names = own["source"].tolist()
                for i, j in np.argwhere(np.ones_like(sums)):
                    a, b = names[low * side + i], names[high * side + j]
                    if low * side + i < high * side + j:
                        assert want[lang, a, b] == want[lang, b, a] == sums[i, j]


def test_many_groups(spark):
    """More groups than a square has rows: several blocks, some strips without any of their cells."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(700)]
    rows = []
    for i in range(2_400):
        part = (i % 150) // 30
        rows.append((" ".join(words[part * 140 + (i * 7 + j) % 140] for j in range(12)), "en", f"s{i % 150:03}"))
    docs = spark.createDataFrame([(i, t, lang, s, "", 0) for i, (t, lang, s) in enumerate(rows)], SCHEMA)
    got = sorted(tuple(r) for r in divergence.audit(docs).collect())
    assert got == plain(rows) and len([r for r in got if r[2] == "pair"]) == 150 * 149


def test_empty_and_long(spark, monkeypatch):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    only = spark.createDataFrame([(None, "Ab cd", "en", "s", "", 0)], SCHEMA)
    assert divergence.audit(only).collect() == []
    long = "One twO three " * 200_000
    rows = [(long, "en", "a")] * 2 + [("two, four; x" + "y" * 100_000, "en", "b")] * 10
    docs = spark.createDataFrame([(None, *r, "", 0) for r in rows], SCHEMA)
    assert sorted(tuple(r) for r in divergence.audit(docs, least_docs=2).collect()) == plain(rows, 2)


def test_words_in_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    text = "Ab, cdefghijklmnop éÉ  x1y" * 5
    got = [w.decode() for part in divergence._words(text.encode()) for w in part]
    assert got == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))
