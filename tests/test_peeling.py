"""Peeling: ends are held in partitions by the number of edges, and the edges are not sorted."""

from sievework.operators import reach
from tests.conftest import rows


def test_partitions_follow_the_edges(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(reach, "parts", lambda n: asked.append(n) or 3)
    edges = [(i, 1_000 + i % 9) for i in range(200)] + [(2_000, 2_001), (2_001, 2_000), (2_001, 2_000), (None, 1), (1, None)]
    found = reach.cyclic_edges(spark.createDataFrame(edges, "from_id long, to_id long"))
    assert rows(found) == [(2_000, 2_001), (2_001, 2_000)]
    assert asked and asked[0] == len(edges)
