"""Passages against a plain re-telling of the packing rule; scores, budgets, artifacts, run log."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.operators import artifacts, corpus, runlog
from tests.conftest import rows


def packed(name, text, tokens):
    """Brute force: what the packing rule says, paragraph by paragraph."""
    head = f"[Source: {name}]\n"
    passages, size = [[]], len(head)
    for p in (x.strip() for x in re.split(r"\n\s*\n", text.strip())):
        if not p:
            continue
        if size + len(p) + 2 > tokens * 4:
            passages.append([])
            size = len(head)
        passages[-1].append(p)
        size += len(p) + 2
    return [(head + "\n\n".join(ps)).strip() for ps in passages]


TEXTS = [
    "",
    "  \n\n ",
    "one\n\ntwo\n \t\nthree",
    "x" * 300 + "\n\nshort\n\n" + "y" * 200,
    " edge \n　\nmore\x1f",
    "\n\n".join("word " * n for n in range(1, 40)),
]


def test_passages(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id INT, text STRING")
    got = {}
    for r in corpus.chunks(df, 40).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk"])
    assert got == {i: packed(i, t, 40) for i, t in enumerate(TEXTS)}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té", max_size=120), min_size=20, max_size=40))
def test_passages_of_any_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING")
    got = {}
    for r in corpus.chunks(df, 12).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk"])
    assert got == {i: packed(i, t, 12) for i, t in enumerate(texts)}


def test_scores_and_order(spark):
    df = spark.createDataFrame(
        [(1, 0, "aaaa Data"), (1, 1, "data DATA"), (2, 0, "none"), (2, 1, "data data")], "doc_id INT, chunk_no INT, chunk STRING"
    )
    got = corpus.top_k(df, {"q": ["DATA", ""], "aa": ["aa"], "z": []}, k=2)
    assert rows(got.select("query", "place", "score", "doc_id", "chunk_no")) == [
        ("aa", 1, 2, 1, 0), ("aa", 2, 0, 1, 1), ("q", 1, 2, 1, 1), ("q", 2, 2, 2, 1), ("z", 1, 0, 1, 0), ("z", 2, 0, 1, 1),
    ]


def test_budget_stops_at_the_first_that_does_not_fit(spark):
    df = spark.createDataFrame([("q", 1, "x" * 40), ("q", 2, "x" * 400), ("q", 3, "x")], "query STRING, place INT, chunk STRING")
    got = corpus.fit_budget(df, max_tokens=50)
    assert [(r["place"], r["tokens"]) for r in got.collect()] == [(1, 10)]


def test_keywords(spark):
    df = spark.createDataFrame([(1, "The (customer),  'Orders'! and data: data.")], "id INT, text STRING")
    got = corpus.keywords(df, "id", "text")
    assert sorted(r[1] for r in got.collect()) == ["customer", "data", "orders'!"]


def results(spark, *outputs):
    return spark.createDataFrame([(i, o) for i, o in enumerate(outputs)], "run INT, output STRING")


RULE = '{"rule_id": "DQ_001", "rule_type": "NOT_NULL", "priority": "P1", "column": "id"}'


def test_rule_documents(spark):
    one = '{"table_name": "t", "dq_rules": [%s]}' % RULE
    df = results(
        spark, one, f"```json\n{one}\n```", f"  ```\n{one}\n```  ", '{"tables": [%s, %s]}' % (one, one), f"[{one}]",
        '{"table_name": "t", "dq_rules": []}', "{broken", "", None,
    )
    got = artifacts.rules(df, ["run"])
    assert [r["run"] for r in got.orderBy("run").collect()] == [0, 1, 2, 3, 3, 4]
    assert {(r["table_name"], r["rule_id"], r["column"]) for r in got.collect()} == {("t", "DQ_001", "id")}
    assert sorted(r["run"] for r in artifacts.unreadable(df).collect()) == [6, 7, 8]


def test_other_documents(spark):
    model = '{"entities": [{"entity_type": "hub", "table_name": "HUB_X", "columns": [{"name": "x_hk", "nullable": false}]}]}'
    assert artifacts.model_columns(results(spark, model)).first()["column_name"] == "x_hk"
    graph = '{"lineage_graph": {"nodes": [{"id": "a"}], "edges": []}}'
    edged = '{"lineage_graph": {"nodes": [{"id": "a"}], "edges": [{"from": "a", "to": "b"}]}}'
    assert artifacts.lineage_nodes(results(spark, graph, edged)).count() == 2
    assert artifacts.lineage_nodes(results(spark, f"[{graph}, {edged}]")).count() == 2
    assert artifacts.lineage_edges(results(spark, graph, edged)).first()["to"] == "b"
    bare = '{"source_table": "s", "target_table": "t", "column_mappings": [{"source_column": "a"}]}'
    got = artifacts.mapping_rows(results(spark, bare, '{"sttm": %s}' % bare))
    assert [(r["source_table"], r["source_column"]) for r in got.collect()] == [("s", "a")] * 2


def test_cost(spark):
    df = spark.createDataFrame([("Claude x", 1000, 100), ("open", 1000, 100)], "model STRING, token_prompt INT, token_completion INT")
    assert [r["cost_usd"] for r in runlog.with_cost(df).collect()] == [0.0225, 0.0065]


def test_first_results(spark):
    df = spark.createDataFrame([(2, "a", None, "late"), (1, "a", None, "early"), (3, "a", "", "other")], "t INT, x STRING, y STRING, out STRING")
    got = runlog.first_results(df, ["x", "y"], ["t"], "out")
    assert sorted((r["out"], r["runs"]) for r in got.collect()) == [("early", 2), ("other", 1)]


def test_latest(spark):
    df = spark.createDataFrame([("a", i) for i in range(30)] + [("b", 1)], "agent_id STRING, t INT")
    assert runlog.latest(df, 20, [F.desc("t")], by="agent_id").groupBy("agent_id").count().collect() == [("a", 20), ("b", 1)]
    assert [r["t"] for r in runlog.latest(df, 2, [F.desc("t")]).collect()] == [29, 28]


@pytest.mark.parametrize("chars,expected", [(0, 1), (3, 1), (8, 2), (11, 2)])
def test_tokens(spark, chars, expected):
    df = spark.createDataFrame([("x" * chars,)], "text STRING")
    assert corpus.over_budget(df, "text", 1).first()["tokens"] == expected
