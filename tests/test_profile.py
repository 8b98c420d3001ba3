"""Profiles, key detection, inventories."""

from decimal import Decimal

import pytest
from pyspark.sql import types as T

from sievework.operators import keys, profile
from sievework.sources import catalog, files, metadata, sinks
from tests.conftest import rows

SCHEMA = "id BIGINT, name STRING, price DECIMAL(10,2), ratio DOUBLE, tags ARRAY<STRING>, at STRUCT<x: INT>"


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(
        [
            (9007199254740993, "b", None, 0.0, ["x"], (1,)),
            (-5, "a", Decimal(1), -0.0, ["x"], None),
            (3, None, Decimal(2), float("nan"), [], (1,)),
            (3, "a", Decimal(2), None, None, (2,)),
        ],
        SCHEMA,
    )


def test_exact_profile(table):
    got = {r["name"]: r for r in profile.profile(table, "t").collect()}
    assert {r["row_count"] for r in got.values()} == {4}
    assert {n: r["null_count"] for n, r in got.items()} == {"id": 0, "name": 1, "price": 1, "ratio": 1, "tags": 1, "at": 1}
    assert {n: r["distinct_count"] for n, r in got.items()} == {"id": 3, "name": 2, "price": 2, "ratio": 2, "tags": 2, "at": 2}
    assert got["name"]["null_pct"] == 0.25
    assert got["name"]["sample_values"] == ["a", "b"]
    assert (got["id"]["min_num"], got["id"]["max_num"]) == ("-5", "9007199254740993")
    assert (got["price"]["min_num"], got["price"]["max_num"]) == ("1.00", "2.00")
    assert abs(got["price"]["avg_num"] - 5 / 3) < 1e-9
    assert got["name"]["min_num"] is None


def test_empty_table(table):
    got = profile.profile(table.limit(0), "t").collect()
    assert len(got) == 6
    assert {(r["row_count"], r["null_pct"], r["distinct_count"]) for r in got} == {(0, 0.0, 0)}


def test_sample_profile_keeps_the_whole_row_count(spark):
    got = profile.profile(spark.range(1000), "t", sample_rows=10).first()
    assert (got["row_count"], got["distinct_count"]) == (1000, 10)


def test_partitioning_does_not_change_the_profile(table):
    known = table.drop("ratio")  # NaN is unequal to itself in Python
    assert rows(profile.profile(known.repartition(7), "t")) == rows(profile.profile(known.coalesce(1), "t"))


def test_both_branches_read_one_exchange(spark):
    df = spark.range(100).selectExpr("id", "id % 7 AS k")
    out = profile.profile(df, "t")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def columns(spark, *found):
    return spark.createDataFrame(
        [(t, c, n, d, True) for t, c, n, d in found],
        "table_name STRING, name STRING, row_count BIGINT, distinct_count BIGINT, nullable BOOLEAN",
    )


def test_confidence(spark):
    high = columns(spark, ("Orders", "Customer_ID", 9, 5), ("customer", "customer_id", 5, 5), ("orders2", "shop_id", 1, 1))
    assert rows(keys.resolve(high)) == [
        ("Orders", "Customer_ID", "customer", "customer_id", "high"),
        ("orders2", "shop_id", "shop", "shop_id", "low"),
    ]
    medium = columns(spark, ("orders", "customer_id", 9, 5), ("customer", "code", 5, 5))
    assert rows(keys.resolve(medium)) == [("orders", "customer_id", "customer", "?", "medium")]


def test_one_table_alone_has_no_relationships(spark):
    assert keys.resolve(columns(spark, ("orders", "customer_id", 9, 5))).isEmpty()


def test_primary_key_needs_unique_values(spark):
    df = columns(spark, ("customer", "customer_id", 5, 5), ("order", "order_id", 5, 4), ("empty", "empty_id", 0, 0))
    got = {r["table_name"]: r["is_primary_key"] for r in keys.primary_keys(df).collect()}
    assert got == {"customer": True, "order": False, "empty": False}


def test_pattern_is_settable(spark):
    df = columns(spark, ("orders", "o_custkey", 9, 5), ("cust", "custkey", 5, 5))
    assert rows(keys.resolve(df, pattern=r"^(?:[a-z]_)?(.+?)key$", suffix="key")) == [
        ("orders", "o_custkey", "cust", "custkey", "high")
    ]


def test_schema_names():
    assert catalog.parse_schema_name("samples.tpch") == ("samples", "tpch")
    assert catalog.parse_schema_name(" default ") == ("hive_metastore", "default")
    for bad in ("a.b.c", "", "."):
        with pytest.raises(ValueError):
            catalog.parse_schema_name(bad)


def test_catalog_scan(spark, schema):
    with pytest.raises(ValueError):
        catalog.scan(spark, schema)
    sinks.full_refresh(spark.range(3).withColumnRenamed("id", "t_id"), f"{schema}.t")
    assert catalog.list_tables(spark, schema) == ["t"]
    assert schema in catalog.list_schemas(spark, spark.catalog.currentCatalog())
    assert catalog.list_catalogs(spark)
    row = catalog.inventory(spark, schema, source_prefix="crm").first()
    assert (row["name"], row["data_type"], row["record_source"]) == ("t_id", "bigint", "crm.t")
    tables, cols = profile.profile_schema(spark, schema)
    assert tables.first()["row_count"] == 3
    assert cols.first()["record_source"] == f"{schema}.t"


def test_table_names(spark):
    names = {"/a/b/orders.parquet": "orders", "/a/b/events/": "events", "x.tar.gz": "x", "": "file_table", "/": "file_table"}
    assert {p: files.table_name(p) for p in names} == names
    paths = {"file:///a.b/orders.parquet/part-0.c000": "orders", "file:///a.b/events.csv": "events", "s3://k/a.b/t/x/y.csv": "t"}
    df = spark.createDataFrame([(p,) for p in paths], "p STRING")
    got = {r[0]: r[1] for r in df.select("p", files.table_name_of(df["p"], "/a.b/")).collect()}
    assert got == paths


def test_sample_of_given_size(spark):
    assert files.sample_rows(spark.range(100), 7).count() == 7


def test_formats(spark, tmp_path):
    with pytest.raises(ValueError):
        files.read(spark, "x", "orc")
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id INT, s STRING")
    for fmt in ("csv", "json"):
        sinks.write_result(df, str(tmp_path / fmt), fmt)
        assert rows(files.read(spark, str(tmp_path / fmt), fmt).select("id", "s")) == [(1, "a,b"), (2, None)]
        assert files.read(spark, str(tmp_path / fmt), fmt, schema=df.schema).schema == df.schema


def test_corpus_files(spark, tmp_path):
    for name in ("b.md", "a.txt", "c.json", "d.py"):
        (tmp_path / name).write_text(f"text of {name}\nline two")
    got = rows(files.read_corpus(spark, str(tmp_path)))
    assert [r[0] for r in got] == ["a.txt", "b.md", "c.json"]
    assert got[0][1] == "text of a.txt\nline two"


def test_run_results_of_both_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "agent_id": "x", "run_id": "1", "output": "```json\\n{}\\n```",\n "token_usage": {"prompt": 5}}')
    (tmp_path / "b.json").write_text('{\n "agent_id": "y", "status": "success", "output": {"profiles": []}}')
    got = {r["agent_id"]: r for r in files.read_run_results(spark, str(tmp_path), multi_line=True).collect()}
    assert got["x"]["output"].startswith("```json")
    assert got["x"]["token_usage"]["prompt"] == 5
    assert got["y"]["output"] == '{"profiles": []}'


def test_inventory_files(spark, tmp_path):
    (tmp_path / "one.json").write_text(
        '{"table_name": "customer", "row_count": 7, "owner": {"team": "crm"},\n'
        ' "columns": [{"name": "id", "data_type": "Decimal(18,2)", "nullable": false,\n'
        '   "sample_values": ["1","2","3","4","5","6"], "unknown": 1}]}'
    )
    (tmp_path / "many.json").write_text(
        '[{"columns": [{"name": "a", "data_type": "int"}]}, {"table_name": "e", "columns": []},'
        ' {"table_name": "f", "columns": [{"name": "a"}]}, {"table_name": "g", "columns": [{"name": "a", "data_type": "int"}]}]'
    )
    (tmp_path / "bad.json").write_text("nothing here")
    good, rejects = metadata.read_inventory(spark, str(tmp_path), lines=False)
    got = {r["table_name"]: r for r in good.collect()}
    assert set(got) == {"customer", "g"}
    column = got["customer"]["columns"][0]
    assert (column["data_type"], column["nullable"], column["sample_values"]) == ("decimal(18,2)", False, ["1", "2", "3", "4", "5", "6"])
    assert got["customer"]["extra"] == {"owner": '{"team":"crm"}'}
    assert (got["g"]["database"], got["g"]["row_count"], got["g"]["columns"][0]["nullable"]) == ("", 0, True)
    assert sorted(r["reason"] for r in rejects.collect()) == [
        "column without name or data_type", "missing or empty columns", "missing table_name", "not an object or array",
    ]


def test_ddl_keeps_not_null():
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("s", T.StringType())])
    assert sinks.ddl("db.t", schema) == (
        "CREATE TABLE IF NOT EXISTS db.t (\n  `id` BIGINT NOT NULL,\n  `s` STRING\n) USING PARQUET"
    )


def test_decimals_of_any_scale_and_repeated_hours(spark):
    df = spark.sql(
        "SELECT CAST('12345678901234567890123456789012345678' AS DECIMAL(38,0)) AS wide, CAST('1.000000000000000001' AS DECIMAL(20,18)) AS fine"
    )
    got = {r["name"]: r for r in profile.profile(df, "t").collect()}
    assert (got["wide"]["min_num"], got["fine"]["max_num"]) == ("12345678901234567890123456789012345678", "1.000000000000000001")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        hours = spark.sql("SELECT explode(array(1699160400, 1699164000, 1699167600)) AS s").selectExpr("timestamp_seconds(s) AS at")
        assert profile.profile(hours, "t").first()["distinct_count"] == 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
