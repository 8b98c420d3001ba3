"""Hash keys, hubs, links, history, snapshots; recon and mapping."""

import datetime
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.functions.hashing import diff_text, hash_key, key_text
from sievework.functions.ordered import changes, with_neighbour
from sievework.operators import mapping, recon, vault
from tests.conftest import rows


def day(d, hour=0):
    return datetime.datetime(2024, 1, d, hour)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_key_text(spark):
    df = spark.createDataFrame([(" ab ", None), (None, "C"), ("a", "b")], "x STRING, y STRING")
    got = [r[0] for r in df.select(key_text(F.col("x"), F.col("y"))).collect()]
    assert got == ["AB|N/A", "N/A|C", "A|B"]
    assert df.select(hash_key(F.col("x"), F.col("y"))).first()[0] == sha("AB|N/A")
    assert df.select(hash_key(F.col("x"), binary=True)).first()[0] == bytearray.fromhex(sha("AB"))


def test_different_keys_have_different_texts(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("n/a", "c"), (None, "c"), ("a\\", "|c")], "x STRING, y STRING")
    got = [r[0] for r in df.select(key_text(F.col("x"), F.col("y"))).collect()]
    assert got == ["A\\|B|C", "A|B\\|C", "\\N/A|C", "N/A|C", "A\\\\|\\|C"]
    assert len(set(got)) == 5


def test_diff_text_keeps_columns_apart(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "N"), ("\\N", "N")], "x STRING, y STRING")
    got = [r[0] for r in df.select(diff_text(F.col("x"), F.col("y"))).collect()]
    assert len(set(got)) == 4


def test_hub_keeps_the_earliest_of_equal_keys(spark):
    a = spark.createDataFrame([("c1",), (" C1 ",), ("c2",), (None,)], "k STRING")
    b = spark.createDataFrame([("c2", day(1)), ("c3", day(9))], "code STRING, at TIMESTAMP_NTZ")
    sources = [vault.Source(a, ["k"], "crm", "2024-01-05"), vault.Source(b, ["code"], "erp", F.col("at"))]
    got = {r["customer_hk"]: r for r in vault.hub("customer", sources, ["k"]).collect()}
    assert set(got) == {sha("C1"), sha("C2"), sha("C3"), "0" * 64}
    assert (got[sha("C2")]["record_source"], got[sha("C2")]["load_date"]) == ("erp", day(1))
    assert got["0" * 64]["record_source"] == "GHOST"


def test_link_points_missing_keys_at_the_ghost(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (1, None)], "o INT, c INT")
    got = vault.link("oc", [vault.Source(df, ["o", "c"], "erp", "2024-01-01")], {"o": ["o"], "c": ["c"]}).collect()
    assert sorted(r["c_hk"] for r in got) == sorted(["0" * 64, sha("2")])
    assert {r["oc_hk"] for r in got} == {sha(sha("1").upper() + "|" + sha("2").upper()), sha(sha("1").upper() + "|" + "0" * 64)}


def staged(spark, *given):
    df = spark.createDataFrame([(k, d, a, i) for i, (k, d, a) in enumerate(given)], "k INT, d TIMESTAMP_NTZ, a STRING, i INT")
    return vault.stage(df, "hk", ["k"], F.col("d"), ["a"], "src", ["i"])


def simple(sat):
    return sorted(
        (r["hk"] == sha("1"), r["load_date"].day, r["load_end_date"].day if r["load_end_date"] else None, r["a"])
        for r in sat.collect()
    )


HISTORY = [
    (1, day(1), "x"), (1, day(1), "a"), (1, day(2), "a"), (1, day(3), "b"), (1, day(5), None), (1, day(6), None),
    (2, day(4), "z"),
]
EXPECTED = [(False, 4, None, "z"), (True, 1, 3, "a"), (True, 3, 5, "b"), (True, 5, None, None)]


@pytest.mark.parametrize("chunk", [None, "day", "month"])
def test_history(spark, chunk):
    assert simple(vault.history(staged(spark, *HISTORY), "hk", chunk)) == EXPECTED


@pytest.mark.parametrize("chunk", [None, "day"])
def test_first_load_equals_staged_history(spark, chunk):
    df = spark.createDataFrame([(k, d, a, i) for i, (k, d, a) in enumerate(HISTORY)], "k INT, d TIMESTAMP_NTZ, a STRING, i INT")
    first = vault.satellite(df, "hk", ["k"], F.col("d"), ["a"], "src", ["i"], chunk)
    assert rows(first) == rows(vault.history(staged(spark, *HISTORY), "hk", None))


@pytest.mark.parametrize("chunk", [None, "day"])
def test_late_rows_find_their_place(spark, chunk):
    early = [r for r in HISTORY if r[1].day not in (3, 5)]
    late = [r for r in HISTORY if r[1].day in (3, 5)]
    first = vault.history(staged(spark, *early), "hk", chunk)
    merged = vault.merge_history(first, staged(spark, *late), "hk", chunk)
    again = vault.merge_history(merged, staged(spark, *late), "hk", chunk)
    # the row of day 6 equals that of day 5 and is dropped
    assert simple(merged) == EXPECTED
    assert simple(again) == EXPECTED


def test_neighbours_in_chunks_equal_those_of_one_window(spark):
    df = spark.range(3000).selectExpr("CAST(id % 3 AS INT) AS k", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id * id % 9973 * 7) AS t", "id")
    df = df.dropDuplicates(["k", "t"])
    whole = with_neighbour(df, ["k"], "t", "id", "near")
    pieces = with_neighbour(df, ["k"], "t", "id", "near", F.date_trunc("hour", "t"))
    assert rows(whole) == rows(pieces)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 400), st.sampled_from("ab")), min_size=1, max_size=120))
def test_changes_in_chunks_equal_those_of_one_window(spark, given_rows):
    known = {(k or None, m): v for k, m, v in given_rows}
    df = spark.createDataFrame(
        [(k, day(1) + datetime.timedelta(minutes=m), v) for (k, m), v in known.items()], "k INT, t TIMESTAMP_NTZ, v STRING"
    )
    whole = changes(df, ["k"], "t", "v", "until")
    pieces = changes(df, ["k"], "t", "v", "until", F.date_trunc("hour", "t"))
    assert rows(whole) == rows(pieces)


def test_point_in_time_covers_each_snapshot_once(spark):
    sat = vault.history(staged(spark, *HISTORY), "hk", None)
    pit = vault.point_in_time({"s": sat}, "hk", "2024-01-01", "2024-01-07")
    got = sorted((r["snapshot_date"].day, r["s_load_date"].day) for r in pit.filter(F.col("hk") == sha("1")).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5), (7, 5)]


def test_snapshots_at_midnight(spark):
    sat = vault.history(staged(spark, (1, day(1, 5), "a"), (1, day(4, 0), "b"), (1, day(6, 1), "c")), "hk", None)
    pit = vault.point_in_time({"s": sat}, "hk", "2024-01-01", "2024-01-09", every_days=2)
    got = sorted((r["snapshot_date"].day, r["s_load_date"].day) for r in pit.collect())
    assert got == [(3, 1), (5, 4), (7, 6), (9, 6)]


def test_names_and_mandatory_columns(spark):
    assert vault.entity_name("satellite", "customer", "details") == "SAT_CUSTOMER_DETAILS"
    df = spark.createDataFrame([(1, 2)], "`Customer ID` INT, loadDate INT")
    assert vault.snake_columns(df).columns == ["customer_id", "load_date"]
    assert vault.missing_columns(vault.snake_columns(df), "hub", "customer", ["customer_id"]) == ["customer_hk", "record_source"]


def test_change_rates(spark):
    got = vault.change_rates(staged(spark, *HISTORY), "hk", ["a"], chunk=None).first()
    assert (got["steps"], got["changes"], got["change_rate"]) == (4, 2, 0.5)


def test_row_difference_counts_copies(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "i INT, s STRING")
    b = spark.createDataFrame([("x", 2), (None, 1), ("y", 3)], "s STRING, i INT")
    assert rows(recon.row_difference(a, b)) == [(1, None, 1), (3, "y", -1)]
    assert recon.row_difference(a, a.repartition(3)).isEmpty()


def test_measures_with_missing_and_null_keys(spark):
    a = spark.createDataFrame([(1, 10), (2, 5), (None, 1), (4, None)], "k INT, v INT")
    b = spark.createDataFrame([(1, 4), (1, 6), (3, 5), (None, 1), (4, None)], "k INT, v INT")
    assert rows(recon.measures(a, b, ["k"], {"v": "v"})) == [(2, 5, None), (3, None, 5)]
    c = b.withColumn("v", F.col("v") + 1)
    assert [r["k"] for r in recon.measures(b, c, ["k"], {"v": "v"}, tolerance=1).collect()] == [1]


def test_mapping(spark):
    df = spark.createDataFrame([(1, "7"), (2, "x"), (3, None)], "id INT, n STRING")
    m = mapping.Mapping("s", "t", [mapping.ColumnMapping("id", "key", "bigint"), mapping.ColumnMapping("n", "n", "int", nullable=False)])
    out = mapping.apply(df, m, "2024-01-01", "crm.s")
    assert [(r["key"], r["n"], r["record_source"]) for r in out.orderBy("key").collect()] == [
        (1, 7, "crm.s"), (2, None, "crm.s"), (3, None, "crm.s"),
    ]
    assert rows(mapping.rejects(df, m)) == [("key", 0, 0), ("n", 1, 2)]
    assert mapping.unmapped(spark.createDataFrame([], "key INT, other INT, load_date DATE").schema, m) == ["other"]


@pytest.mark.parametrize("rule", ["(SELECT max(id) FROM t)", "1; DROP TABLE t"])
def test_mapping_rejects_more_than_an_expression(rule):
    with pytest.raises(ValueError):
        mapping.expression(mapping.ColumnMapping("DERIVED", "x", "int", rule))


def test_derived_needs_a_rule():
    with pytest.raises(ValueError):
        mapping.expression(mapping.ColumnMapping("DERIVED", "x", "int"))


def test_mapping_from_rows(spark):
    df = spark.createDataFrame(
        [("s", "t", "id", "key", "bigint", "DIRECT COPY", None), ("s", "t", "DERIVED", "up", "string", "upper(n)", False)],
        "source_table STRING, target_table STRING, source_column STRING, target_column STRING, target_data_type STRING, "
        "transformation_rule STRING, nullable BOOLEAN",
    )
    m = mapping.from_rows(df)
    out = mapping.apply(spark.createDataFrame([(1, "a")], "id INT, n STRING"), m, "2024-01-01", "x")
    assert out.select("key", "up").first() == (1, "A")
