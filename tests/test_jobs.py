"""Ingestion reruns, streams, sinks, lineage, synthetic rows."""

import json

import pytest
from pyspark.sql import functions as F

from sievework.functions.hashing import draw
from sievework.operators import lineage, synth
from sievework.operators.checks import Rule
from sievework.operators.synth import ColumnSpec
from sievework.plans import ingest
from sievework.plans.ingest import IngestSpec
from sievework.registered.registry import scratch_schema
from sievework.sources import files, sinks
from sievework.streaming import changes, quality
from tests.conftest import rows


@pytest.fixture
def landing(spark, tmp_path):
    """(write one more file, spec factory)"""
    schema, folder = scratch_schema(spark)
    path = tmp_path / "landing"
    path.mkdir()
    files_written = []

    def land(*values):
        name = path / f"part-{len(files_written)}.json"
        name.write_text("\n".join(json.dumps({"id": i, "v": v}) for i, v in values))
        files_written.append(name)

    def spec(load_type, **more):
        return IngestSpec(
            "t", load_type=load_type, source_format="json", source_path=str(path), target_schema=schema,
            checkpoint_base=f"{folder}/c", **more,
        )

    return land, spec


def test_incremental_loads_new_files_only(spark, landing):
    land, spec = landing
    s = spec("incremental", columns=["id"], record_source="crm", load_date="2024-01-01")
    land((1, "a"), (2, "b"))
    ingest.run(spark, s)
    ingest.run(spark, s)
    land((3, "c"))
    ingest.run(spark, s)
    got = spark.table(s.target)
    assert got.columns == ["id", "load_date", "record_source"]
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3]
    assert {r["record_source"] for r in got.collect()} == {"crm.t"}


def test_kept_schema_outlives_the_first_run(spark, landing):
    land, spec = landing
    land((1, "a"))
    s = spec("incremental")
    ingest.run(spark, s)
    assert ingest.stored_schema(spark, s).names == ["id", "v"]
    land((2, 5))
    ingest.run(spark, s)
    assert rows(spark.table(s.target)) == [(1, "a"), (2, "5")]


def test_full_refresh_replaces(spark, landing):
    land, spec = landing
    s = spec("full")
    land((1, "a"))
    ingest.run(spark, s)
    land((2, "b"))
    ingest.run(spark, s)
    assert rows(spark.table(s.target)) == [(1, "a"), (2, "b")]


def test_merge_keeps_the_newest_row(spark, landing):
    land, spec = landing
    s = spec("merge", keys=["id"], sequence=["v"])
    land((1, 5), (2, 1), (1, 7))
    ingest.run(spark, s)
    land((1, 6), (2, 2))
    ingest.run(spark, s)
    assert rows(spark.table(s.target).select("id", "v")) == [(1, 7), (2, 2)]


def test_load_types(spark, landing):
    _, spec = landing
    with pytest.raises(ValueError):
        ingest.run(spark, spec("sometimes"))
    with pytest.raises(ValueError):
        ingest.run(spark, spec("merge", schema=spark.range(1).schema))


def test_one_load_per_table(spark, landing):
    land, spec = landing
    land((1, "a"))
    first = spec("full")
    second = IngestSpec(**{**first.__dict__, "table": "u", "load_type": "incremental"})
    assert ingest.run_all(spark, [first, second]) == []
    assert rows(spark.table(second.target)) == rows(spark.table(first.target)) == [(1, "a")]


def test_paths():
    s = IngestSpec("orders", checkpoint_base="/chk")
    assert (s.path, s.checkpoint, s.schema_path, s.target) == (
        "/chk/source/orders/", "/chk/orders/checkpoint", "/chk/orders/schema", "bronze.orders",
    )


def test_upsert_drops_old_versions_and_matches_null_keys(spark, schema):
    target = f"{schema}.t"
    for batch in ([(1, "a"), (None, "n")], [(1, "b"), (None, "m")], [(2, "c")]):
        sinks.upsert(spark.createDataFrame(batch, "k INT, v STRING"), target, ["k"])
    assert rows(spark.table(target)) == [(1, "b"), (2, "c"), (None, "m")]
    assert sinks.versions(spark, target) == [2, 3]


def test_load_strategies(spark, schema):
    df = spark.range(3)
    with pytest.raises(ValueError):
        sinks.load(df, f"{schema}.x", "REPLACE")
    with pytest.raises(ValueError):
        sinks.load(df, f"{schema}.x", "MERGE")


def test_upsert_reduces_or_refuses_shared_keys(spark, schema):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k INT, at INT, v STRING")
    with pytest.raises(ValueError, match="sequence"):
        sinks.load(df, f"{schema}.shared", "MERGE", ["k"])
    sinks.load(df, f"{schema}.shared", "MERGE", ["k"], ["at"])
    assert rows(spark.table(f"{schema}.shared")) == [(1, 2, "b"), (2, 1, "c")]



def write_events(spark, path, values):
    df = spark.createDataFrame(values, "id INT, ts STRING, v INT").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def test_windowed_counts_over_several_batches(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for day in (1, 2):
        schema = write_events(spark, path, [(i, f"2024-01-0{day} 0{i}:00:00", i if i % 2 else None) for i in range(6)])
        schema = write_events(spark, path, [(9, f"2024-01-0{day} 23:30:00", 1)])
    stream = files.stream(spark, path, "parquet", schema, maxFilesPerTrigger="1")
    counts = quality.windowed_counts(stream, "ts", [], ["v"], delay="2 days")
    quality.write_updates(counts, out, str(tmp_path / "c"), availableNow=True).awaitTermination()
    got = quality.read_updates(spark, out, ["window_start"])
    assert sorted((r["window_start"].day, r["rows"], r["null_v"]) for r in got.collect()) == [(1, 7, 3), (2, 7, 3)]


def test_stream_dedupe_across_batches(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in range(2):
        schema = write_events(spark, path, [(i, "2024-01-01 00:00:00", i) for i in range(4)])
    stream = files.stream(spark, path, "parquet", schema, maxFilesPerTrigger="1")
    kept = quality.first_rows(stream, "ts", ["id"])
    writer = kept.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    writer.foreachBatch(quality.per_batch(out)).start().awaitTermination()
    assert rows(spark.read.parquet(out).select("id")) == [(0,), (1,), (2,), (3,)]


def test_stream_split(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = write_events(spark, path, [(1, "2024-01-01 00:00:00", 5), (2, "2024-01-01 00:00:00", None)])
    rules = [Rule("t", "NOT_NULL", "v")]
    quality.write_split(files.stream(spark, path, "parquet", schema), rules, out, str(tmp_path / "c"), availableNow=True).awaitTermination()
    got = spark.read.option("basePath", out).parquet(out)
    assert rows(got.select("id", "verdict")) == [(1, "good"), (2, "bad")]


def test_changes_arriving_late_do_not_win(spark, tmp_path, schema):
    path = str(tmp_path / "in")
    target = f"{schema}.users"
    for values in ([(1, "2024-01-05 00:00:00", 1)], [(1, "2024-01-03 00:00:00", 2), (2, "2024-01-01 00:00:00", 3)]):
        kept = write_events(spark, path, values)
        stream = files.stream(spark, path, "parquet", kept)
        changes.apply_changes(stream, target, ["id"], ["ts"], str(tmp_path / "c"), availableNow=True).awaitTermination()
    assert rows(spark.table(target).select("id", "v")) == [(1, 1), (2, 3)]


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "from_id STRING, to_id STRING")


def test_closure_ends_on_cycles(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"))
    roots = spark.createDataFrame([("a",)], "id STRING")
    assert rows(lineage.closure(e, roots)) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 3)]
    assert rows(lineage.closure(e, roots, downstream=False, max_depth=1)) == [("a", "c", 1)]


def test_cyclic_edges(spark):
    e = edges(spark, ("x", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"))
    assert rows(lineage.cyclic_edges(e)) == [("a", "b"), ("b", "c"), ("c", "a")]
    assert lineage.cyclic_edges(edges(spark, ("a", "b"), ("b", "c"), ("a", "c"))).isEmpty()


def test_edges_between_cycles_are_innocent(spark):
    e = edges(spark, ("a", "b"), ("b", "a"), ("b", "m"), ("m", "c"), ("c", "d"), ("d", "c"))
    assert rows(lineage.cyclic_edges(e)) == [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")]
    e = edges(spark, ("1", "p"), ("p", "1"), ("2", "q"), ("q", "2"), ("3", "r"), ("r", "3"), ("4", "s"), ("s", "4"), ("1", "3"), ("3", "4"), ("4", "2"))
    assert rows(lineage.cyclic_edges(e)) == sorted([("1", "p"), ("p", "1"), ("2", "q"), ("q", "2"), ("3", "r"), ("r", "3"), ("4", "s"), ("s", "4")])


def test_edge_rules(spark):
    df = spark.createDataFrame(
        [("Src CRM", "HUB_Customer", None), ("Src CRM", "HUB_Customer", " "), ("HUB_Customer", "DIM Customer", "Unknown")],
        "source STRING, target STRING, rule STRING",
    )
    e = lineage.edges(df)
    assert rows(e.select("from_id", "to_id", "transformation")) == [
        ("hub_customer", "dim_customer", "passthrough"), ("src_crm", "hub_customer", "passthrough"),
    ]
    layers = {r["id"]: r["layer"] for r in lineage.nodes(e).collect()}
    assert layers == {"src_crm": "source", "hub_customer": "silver", "dim_customer": "gold"}
    assert rows(lineage.layer_jumps(e).select("from_id", "step")) == [("src_crm", 2)]


SPECS = [
    ColumnSpec("order_id", "bigint", False), ColumnSpec("email"), ColumnSpec("country_name"), ColumnSpec("account", "int"),
    ColumnSpec("user_type"), ColumnSpec("status", "int"), ColumnSpec("is_active", "boolean"), ColumnSpec("born", "date"),
    ColumnSpec("tags", "array<string>", False), ColumnSpec("attrs", "map<string,string>", False), ColumnSpec("price", "decimal(10,2)"),
    ColumnSpec("plan", "string", True, ["x", "y"]), ColumnSpec("level"), ColumnSpec("room_count", "int", False), ColumnSpec("branch_code"),
]


def test_synthetic_rows(spark):
    df = synth.table(spark, "t", SPECS, rows=2000, rules="level in gold or silver; other must be 1")
    got = df.collect()
    assert len(got) == 2000
    assert [r["order_id"] for r in sorted(got)][:2] == [1001, 1002]
    share = sum(r["email"] is None for r in got) / 2000
    assert 0.15 < share < 0.25
    assert all(r["email"] is None or r["email"].count("@") == 1 for r in got)
    assert {r["user_type"] for r in got} == {*synth.USER_TYPES, None}
    assert all(isinstance(r["status"], int) or r["status"] is None for r in got)
    assert {r["is_active"] for r in got} == {True, False}
    assert {r["level"] for r in got} == {"gold", "silver"}
    assert {r["plan"] for r in got} == {"x", "y"}
    assert all(1 <= r["room_count"] <= 10 for r in got)
    assert all(r["branch_code"] is not None for r in got)
    assert all(r["country_name"] is None or r["country_name"].startswith("country_name_") for r in got)
    assert all(r["tags"] == [] and r["attrs"] == {} for r in got)


def test_synthetic_rows_do_not_depend_on_partitions(spark):
    few = synth.generate(spark.range(0, 300, 1, 2), F.col("id"), "t", SPECS, seed=3)
    many = synth.generate(spark.range(0, 300, 1, 9), F.col("id"), "t", SPECS, seed=3)
    other = synth.generate(spark.range(0, 300, 1, 2), F.col("id"), "t", SPECS, seed=4)
    assert few.drop("attrs").exceptAll(many.drop("attrs")).isEmpty()
    assert not few.drop("attrs").exceptAll(other.drop("attrs")).isEmpty()


def test_specs_from_a_schema(spark):
    schema = spark.createDataFrame([], "user_id BIGINT, at DATE").schema
    assert synth.specs_of(schema) == [ColumnSpec("user_id", "bigint"), ColumnSpec("at", "date")]


def test_every_type_can_be_made(spark):
    types = ["tinyint", "smallint", "int", "bigint", "float", "double", "decimal(5,1)", "boolean", "date", "timestamp", "timestamp_ntz", "binary", "struct<a:int>"]
    df = synth.table(spark, "t", [ColumnSpec(f"c{i}", t) for i, t in enumerate(types)], rows=20)
    assert df.count() == 20
    df.collect()


def test_constraint_text():
    assert synth.constraints("status must be one of: a, b ; Kind should be 'x' or \"y\"; nonsense") == {
        "status": ["a", "b"], "kind": ["x", "y"],
    }


def test_draws_are_spread(spark):
    d = spark.range(4000).select((draw(1, "t", "c", F.col("id")) % 4).alias("q"))
    counts = [r["count"] for r in d.groupBy("q").count().collect()]
    assert len(counts) == 4 and min(counts) > 850
