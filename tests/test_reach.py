"""Cycles and the label index against plain searches."""

import random
import time

import pytest

from sievework.operators import reach
from tests.conftest import rows


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "from_id string, to_id string")


def distances_from(edges, start):
    after, seen, frontier, d = {}, {start: 0}, [start], 0
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    while frontier:
        d += 1
        frontier = list({y for x in frontier for y in after.get(x, ()) if y not in seen})
        seen.update(dict.fromkeys(frontier, d))
    return seen


def plain_cyclic(edges):
    reached = {a: distances_from(edges, a) for a in {x for e in edges for x in e}}
    return sorted((a, b) for a, b in set(edges) if a in reached[b])


def graph(rng, nodes, edges, back=0.1):
    out = []
    for _ in range(edges):
        a, b = rng.randrange(nodes), rng.randrange(nodes)
        out.append((a, b) if a < b or rng.random() < back else (b, a))
    return [(f"n{a}", f"n{b}") for a, b in out]


@pytest.mark.parametrize("seed", range(4))
def test_cycles(spark, seed):
    rng = random.Random(seed)
    edges = graph(rng, 60, 70 + 20 * seed)
    # chains into, out of and between what is there, closed chains, loops of one node
    for c in range(4):
        k = rng.randint(1, 9)
        ends = [f"n{rng.randrange(60)}", *[f"c{c}_{i}" for i in range(k)], f"n{rng.randrange(60)}"]
        edges += list(zip(ends, ends[1:]))
    edges += [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [("self", "self"), ("n1", "self")] + edges[:3]
    assert rows(reach.cyclic_edges(frame(spark, edges))) == plain_cyclic(edges)


def test_a_long_chain_with_a_loop_at_its_end(spark, monkeypatch):
    rounds, cut = [], reach.cut
    monkeypatch.setattr(reach, "cut", lambda df: rounds.append(1) or cut(df))
    n = 100_000
    edges = spark.range(n - 1).selectExpr("id AS from_id", "id + 1 AS to_id").union(spark.sql(f"SELECT {n - 1}L, {n - 10}L"))
    found = rows(reach.cyclic_edges(edges))
    assert found == sorted([(i, i + 1) for i in range(n - 10, n - 1)] + [(n - 1, n - 10)])
    assert len(rounds) <= 40


def test_trees_and_empty_tables(spark):
    tree = [(f"t{i}", f"t{i // 2}") for i in range(1, 200)] + [(f"h{i}", f"h{i + 1}") for i in range(60)]
    tree = [e for e in tree if e[0] != e[1]]
    # wide layers, so that nothing is a chain, with the smallest ids at both ends
    tree += [(f"{'a' if k == 0 else 'z'}{k}_{i}", f"{'a' if k == 10 else 'z'}{k + 1}_{j}") for k in range(11) for i in range(3) for j in range(3)]
    start = time.time()
    assert reach.cyclic_edges(frame(spark, tree)).collect() == [] and time.time() - start < 60
    assert reach.cyclic_edges(frame(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_labels(spark, monkeypatch, seed):
    monkeypatch.setattr(reach, "FIRST", 4)
    monkeypatch.setattr(reach, "GROWTH", 4)
    rng = random.Random(seed)
    edges = graph(rng, 50, 60 + 30 * seed, back=0.15) + [("alone", "alone")]
    labels = reach.label_index(frame(spark, edges))
    ids = sorted({x for e in edges for x in e})
    pairs = [(rng.choice(ids), rng.choice(ids), i) for i in range(400)] + [("alone", "alone", -1), ("nowhere", ids[0], -2)]
    got = {r.i: r.distance for r in reach.distances(spark.createDataFrame(pairs, "from_id string, to_id string, i int"), labels).collect()}
    plain = {a: distances_from(edges, a) for a in ids}
    assert got == {i: plain.get(a, {}).get(b) for a, b, i in pairs}
    size = reach.label_sizes(labels).first()
    assert size.nodes == len(ids) and size.most >= size.mean


def test_labels_of_no_edges(spark):
    assert reach.label_index(frame(spark, [])).collect() == []
