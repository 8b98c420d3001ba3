"""NULL and empty-table rules of every check, injected faults, quarantine, gates."""

import datetime

import pytest
from pyspark.sql import functions as F

from sievework.operators.checks import Rule, excess_copies, load_variance
from sievework.plans import recommend, suite
from sievework.operators import keys, profile
from tests.conftest import rows

AS_OF = "2024-01-31 00:00:00"
SCHEMA = "id BIGINT, s STRING, n INT, ts TIMESTAMP_NTZ, gone STRING"


def at(day, hour=0):
    return datetime.datetime(2024, 1, day, hour)


@pytest.fixture(scope="module")
def six(spark):
    """Six rows, a NULL in every column, one column all NULL."""
    return spark.createDataFrame(
        [
            (1, "a@b.co", 5, at(30), None),
            (2, "bad", 50, at(29), None),
            (2, "a@b.co", None, None, None),
            (None, None, 2147483647, at(28), None),
            (5, "ümlaut", -1, datetime.datetime(2024, 2, 1), None),
            (None, " ", 7, at(30), None),
        ],
        SCHEMA,
    )


CASES = [
    # rule, failures on six rows, failures on none
    (Rule("t", "NOT_NULL", "id"), 2, 0),
    (Rule("t", "COMPLETENESS", "s"), 1, 0),
    (Rule("t", "UNIQUE", "id"), 3, 0),
    (Rule("t", "UNIQUE", "id,s"), 0, 0),
    (Rule("t", "RANGE_CHECK", "n", params={"min": "0", "max": "10"}), 3, 0),
    (Rule("t", "RANGE_CHECK", "n", params={"max": "10"}), 2, 0),
    (Rule("t", "REGEX_PATTERN", "s", params={"pattern": "^[a-z]+@[a-z]+[.][a-z]+$"}), 3, 0),
    (Rule("t", "LIKE_PATTERN", "s", params={"pattern": "%@%.%"}), 3, 0),
    (Rule("t", "LENGTH_CHECK", "s", params={"min": "2", "max": "5"}), 4, 0),
    (Rule("t", "ENUM_CHECK", "s", params={"values": ["bad", " "]}), 3, 0),
    (Rule("t", "ROW_COUNT", params={"min": "0"}), 0, 1),
    (Rule("t", "ROW_COUNT", params={"min": "6"}), 1, 1),
    (Rule("t", "EMPTY_SOURCE"), 0, 1),
    (Rule("t", "ALL_NULL", "gone"), 1, 0),
    (Rule("t", "ALL_NULL", "s"), 0, 0),
    (Rule("t", "FRESHNESS", "ts"), 0, 0),
    (Rule("t", "COMPLETENESS_RATIO", "s", params={"threshold": "0.9"}), 1, 0),
    (Rule("t", "COMPLETENESS_RATIO", "s", params={"threshold": "0.8"}), 0, 0),
    (Rule("t", "FUTURE_TIMESTAMP", "ts"), 1, 0),
    (Rule("t", "RECORD_SOURCE", "s"), 2, 0),
    (Rule("t", "SPECIAL_CHARACTERS", "s"), 1, 0),
    (Rule("t", "NUMERIC_MAX", "n"), 1, 0),
    (Rule("t", "DATE_FORMAT", "s", params={"format": "yyyy-MM-dd"}), 5, 0),
    (Rule("t", "DUPLICATE_ROWS", "id"), 2, 0),
    (Rule("t", "DUPLICATE_BUSINESS_KEY", "id"), 2, 0),
    (Rule("t", "REFERENTIAL", "id", params={"parent": "p", "parent_column": "pk"}), 3, 0),
    (Rule("t", "LOOKUP", "id", params={"parent": "p", "parent_column": "pk"}), 1, 0),
]


def test_every_rule_type_has_a_case():
    from sievework.operators.checks import RULE_TYPES

    assert set(RULE_TYPES) - {r.rule_type for r, _, _ in CASES} == {"RECORD_COUNT_VARIANCE"}


def test_failures_with_nulls_and_without_rows(spark, six):
    parent = spark.createDataFrame([(1,), (2,), (None,)], "pk BIGINT")
    rules = [Rule(r.table, r.rule_type, r.column, params=r.params, rule_id=str(i)) for i, (r, _, _) in enumerate(CASES)]
    for df, place in ((six, 1), (six.limit(0), 2)):
        results = suite.run({"t": df, "p": parent}, rules, AS_OF)
        got = {int(r["rule_id"]): r["failures"] for r in results.collect()}
        expected = {i: case[place] for i, case in enumerate(CASES)}
        assert got == expected


def test_stale_table_fails_freshness(spark, six):
    old = six.filter("ts < '2024-01-30'")
    result = suite.run({"t": old}, [Rule("t", "FRESHNESS", "ts")], AS_OF).first()
    assert (result["failures"], result["passed"]) == (1, False)


def test_variance_between_loads(spark):
    loads = [(at(1),)] * 10 + [(at(2),)] * 11 + [(at(3),)] * 30 + [(at(4),)] * 29 + [(None,)]
    df = spark.createDataFrame(loads, "load TIMESTAMP_NTZ")
    rule = Rule("t", "RECORD_COUNT_VARIANCE", "load", params={"percent": "20"})
    assert suite.run({"t": df}, [rule], AS_OF).first()["failures"] == 1
    previous = {r["n"]: r["previous"] for r in load_variance(df, "load").collect()}
    assert previous == {10: None, 11: 10, 30: 11, 29: 30}


def test_copies_of_rows_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "x")], "a INT, b STRING")
    assert rows(excess_copies(df, ["a", "b"])) == [(1, None, 3)]
    assert rows(excess_copies(df, ["a"])) == [(1, 3)]


def test_unknown_rule_type(six):
    with pytest.raises(ValueError):
        suite.run({"t": six}, [Rule("t", "NO_SUCH_RULE", "id")], AS_OF)


def test_one_scan_for_all_rules_of_a_table(six):
    rules = [r for r, _, _ in CASES if r.rule_type in ("NOT_NULL", "RANGE_CHECK", "REGEX_PATTERN")]
    plan = suite.run({"t": six}, rules, AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1


def test_quarantine_marks_rows_with_what_they_break(six):
    rules = [Rule("t", "NOT_NULL", "id"), Rule("t", "RANGE_CHECK", "n", params={"max": "10"})]
    marked = suite.quarantine(six, rules, AS_OF)
    got = sorted(tuple(r["broken_rules"]) for r in marked.collect())
    assert got == [(), (), (), ("NOT_NULL_id",), ("NOT_NULL_id", "RANGE_CHECK_n"), ("RANGE_CHECK_n",)]


def test_gate_raises_for_blocking_rules_only(six):
    passing = suite.run({"t": six}, [Rule("t", "NOT_NULL", "id"), Rule("t", "EMPTY_SOURCE", fail_action="block")], AS_OF)
    suite.enforce(passing)
    failing = suite.run({"t": six}, [Rule("t", "NOT_NULL", "id", fail_action="block")], AS_OF)
    with pytest.raises(suite.QualityGateError, match="NOT_NULL_id"):
        suite.enforce(failing)


def test_labels_are_whole():
    assert suite.label(Rule("t", "REFERENTIAL", "x" * 60)) == "REFERENTIAL_" + "x" * 60


@pytest.fixture(scope="module")
def profiled(spark):
    orders = spark.createDataFrame(
        [(i, i % 3, f"u{i}@x.com" if i % 10 else None, "new" if i % 2 else "old's", i * 1.5, at(29)) for i in range(1, 101)],
        "order_id BIGINT, customer_id BIGINT, email STRING, state STRING, amount DOUBLE, created_at TIMESTAMP_NTZ",
    )
    customer = spark.createDataFrame([(0, "Ann"), (1, "Bo"), (2, "Cy")], "customer_id BIGINT, name STRING")
    tables = {"order": orders, "customer": customer}
    columns = profile.profile_tables(tables, k=20)
    edges = keys.resolve(columns)
    flagged = keys.with_foreign_keys(keys.primary_keys(columns), edges)
    return tables, flagged.withColumn("is_business_key", F.col("is_primary_key")), edges


def test_recommendations(profiled):
    _, columns, edges = profiled
    got = {(r["table_name"], r["rule_type"], r["column_name"]) for r in recommend.recommend(columns, edges, enum_limit=20).collect()}
    assert {k for t, k, c in got if t == "order" and c == "email"} == {"COMPLETENESS", "REGEX_PATTERN"}
    assert ("order", "UNIQUE", "order_id") in got
    assert ("order", "UNIQUE", "customer_id") not in got
    assert ("order", "REFERENTIAL", "customer_id") in got
    assert ("order", "FRESHNESS", "created_at") in got
    assert ("order", "RANGE_CHECK", "amount") in got
    assert not [c for _, k, c in got if k == "RANGE_CHECK" and c in ("created_at", "state", "order_id")]
    assert ("customer", "ROW_COUNT", None) in got


def test_cap_drops_the_lowest_priority(profiled):
    _, columns, edges = profiled
    full = recommend.recommend(columns, edges, max_rules=100, enum_limit=20).filter("table_name = 'order'")
    cut = recommend.recommend(columns, edges, max_rules=6, enum_limit=20).filter("table_name = 'order'")
    kept = [r["priority"] for r in cut.collect()]
    everything = sorted(r["priority"] for r in full.collect())
    assert sorted(kept) == everything[:6]
    assert sorted(r["rule_id"] for r in cut.collect()) == [f"DQ_00{i}" for i in range(1, 7)]


def test_rule_statements_give_the_suite_counts(spark, profiled):
    tables, columns, edges = profiled
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    rules = recommend.recommend(columns, edges, enum_limit=20).filter("rule_type <> 'FRESHNESS'")
    statements = recommend.sql_text(rules).collect()
    results = suite.run(tables, suite.to_rules(rules), AS_OF)
    counts = {(r["table_name"], r["rule_id"]): r["failures"] for r in results.collect()}
    assert len(statements) == len(counts) > 10
    for s in statements:
        assert spark.sql(s["sql"]).first()[0] == counts[(s["table_name"], s["rule_id"])], s["sql"]


def test_ids_follow_priority(spark):
    df = spark.createDataFrame(
        [("t", "P2", "A", "x"), ("t", "P1", "B", "y"), ("u", "P3", "C", None)],
        "table_name STRING, priority STRING, rule_type STRING, column_name STRING",
    )
    got = {(r["table_name"], r["rule_id"]): r["rule_type"] for r in suite.with_ids(df, "TC").collect()}
    assert got == {("t", "TC_001"): "B", ("t", "TC_002"): "A", ("u", "TC_001"): "C"}


def test_covers(spark, six):
    assert [r.column for r in suite.null_cover("t", six)] == six.columns
    kinds = [r.rule_type for r in suite.boundary_cover("t", six)]
    assert (kinds.count("ALL_NULL"), kinds.count("NUMERIC_MAX"), kinds.count("EMPTY_SOURCE")) == (5, 2, 1)


def test_attach_drops_tables_without_rules(spark):
    rules = spark.createDataFrame([("t", '[{"rule_type": "NOT_NULL", "column": "id"}]')], "table_name STRING, rules STRING")
    tables = spark.createDataFrame([("t",), ("t",), ("u",)], "table_name STRING")
    assert rows(suite.attach(rules, tables).select("table_name", "rule_type", "column_name")) == [("t", "NOT_NULL", "id")]
