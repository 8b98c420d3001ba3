"""What one task of the edge build holds follows a fixed number of rows, not the table."""

from sievework import session
from sievework.operators import lineage
from tests.conftest import rows


def test_edges_in_parts(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    mapping = [(f"A {i}", f"B {i % 7}", "unknown" if i % 2 else " ") for i in range(1_000)] * 2 + [(None, "B 1", None)]
    found = lineage.edges(spark.createDataFrame(mapping, "source string, target string, rule string"))
    assert found.rdd.getNumPartitions() == 21
    want = {("a_" + s[2:] if s else None, "b_" + t[2:], "passthrough" if r != " " else "passthrough", s, t) for s, t, r in mapping}
    assert rows(found) == sorted(want, key=repr)
