"""Nodes: the least label of each id, with NULL ends."""

from sievework import session
from sievework.operators import lineage
from tests.conftest import rows


def test_least_labels(spark):
    mapping = [("A 1", "B-1", "x"), ("a 1", "B-1", "x"), ("A 1", "hub c", "y"), (None, "B-1", "x")]
    found = lineage.nodes(lineage.edges(spark.createDataFrame(mapping, "source string, target string, rule string")))
    assert rows(found) == sorted([("a_1", "A 1", "bronze"), ("b_1", "B-1", "bronze"), ("hub_c", "hub c", "silver"), (None, None, "bronze")], key=repr)


def test_nodes_in_parts(spark, monkeypatch):
    """What one task tells apart and sorts follows a fixed number of rows, not the session's partitions."""
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    schema = "source string, target string, rule string"
    mapping = [(f"A {i}", "Hub x" if i % 2 else "hub X", "r") for i in range(1_000)] + [(None, "Hub x", None)]
    want = sorted([(f"a_{i}", f"A {i}", "bronze") for i in range(1_000)] + [("hub_x", "Hub x", "silver"), (None, None, "bronze")], key=repr)
    for most in (None, 2_000):
        found = lineage.nodes(lineage.edges(spark.createDataFrame(mapping, schema)), most)
        assert found.rdd.getNumPartitions() == (21 if most is None else 40)
        assert rows(found) == want
    # Ends are told apart before the sort for the least label; the optimizer must not leave that out.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 3
