"""As-of joins against a plain look-up, and first rows of a stream under retries, late rows and a hot key."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import asof
from sievework.streaming import quality
from tests.conftest import rows

DAY = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("unit", ["hour", "day", "month", "year"])
def test_against_look_up(spark, unit):
    rng = random.Random(unit)
    hour = lambda: DAY + dt.timedelta(hours=rng.randrange(24 * 70), minutes=rng.choice([0, 30]))
    history = []
    for k in range(6):
        cuts = sorted({hour() for _ in range(rng.randint(0, 9))})
        for a, b in zip(cuts, [*cuts[1:], None]):
            if rng.random() < 0.8:
                history.append((k, a, b, f"v{len(history)}"))
    history += [(7, DAY, DAY, "empty"), (None, DAY, None, "no key")]
    asked = [(i, rng.choice([0, 1, 2, 3, 4, 5, 6, 7, None]), hour() if i % 9 else None) for i in range(300)] + [(999, 0, history[0][1])]
    h = spark.createDataFrame(history, "k int, load_date timestamp_ntz, load_end_date timestamp_ntz, v string")
    q = spark.createDataFrame(asked, "i int, k int, at timestamp_ntz").repartition(3)
    got = {r.i: r.s_v for r in asof.as_of(q, {"s": h}, ["k"], "at", {"s": ["v"]}, unit).collect()}
    want = {i: next((v for hk, a, b, v in history if k is not None and hk == k and at and a <= at and (b is None or at < b)), None) for i, k, at in asked}
    assert got == want and len([v for v in want.values() if v]) > 50


def test_two_histories_over_one_partitioning(spark):
    df = spark.range(2_000).selectExpr("id % 50 AS k", "timestamp_ntz'2024-01-01' + make_dt_interval(0, id) AS at")
    h = df.selectExpr("k", "at AS load_date", "CAST(NULL AS timestamp_ntz) AS load_end_date", "k * 2 AS v").where("load_date < '2024-01-03 02:00:00'")
    out = asof.as_of(df, {"a": h, "b": h.withColumn("v", F.col("v") + 1)}, ["k"], "at", {"a": ["v"], "b": ["v"]}, "month")
    assert out.count() == 2_000 and out.where("a_v <> 2 * k OR b_v <> a_v + 1 OR a_v IS NULL").count() == 0
    assert out.columns == ["k", "at", "a_v", "b_v"]


def test_no_rows_and_unknown_units(spark):
    df = spark.createDataFrame([], "k int, at timestamp_ntz")
    h = spark.createDataFrame([], "k int, load_date timestamp_ntz, load_end_date timestamp_ntz, v string")
    assert asof.as_of(df, {"s": h}, ["k"], "at", {"s": ["v"]}).collect() == []
    with pytest.raises(ValueError):
        asof.as_of(df.unionByName(spark.sql("SELECT 1 AS k, timestamp_ntz'2024-01-01' AS at")), {"s": h}, ["k"], "at", {"s": ["v"]}, "eon")


SCHEMA = "k string, n int, ts timestamp"


def run(spark, place, schema, data, **more):
    spark.createDataFrame([(k, n, DAY + dt.timedelta(hours=h)) for k, n, h in data], SCHEMA).write.mode("append").parquet(f"{place}/feed")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{place}/feed")
    quality.write_first_rows(stream, "ts", ["k"], ["ts", "n"], f"{place}/out", f"{schema}.seen", 4, f"{place}/checkpoint", availableNow=True, **more).awaitTermination()
    return rows(spark.read.option("basePath", f"{place}/out").parquet(f"{place}/out").select("k", "n"))


def test_first_rows(spark, schema, tmp_path):
    hot = [("hot", i, 1) for i in range(500)]
    assert run(spark, tmp_path, schema, [("a", 2, 1), ("a", 1, 1), (None, 5, 2), *hot]) == [("a", 1), ("hot", 0), (None, 5)]
    assert run(spark, tmp_path, schema, [("a", 0, 0), ("b", 7, 3), (None, 1, 1), *hot]) == [("a", 1), ("b", 7), ("hot", 0), (None, 5)]
    plan = spark.createDataFrame(hot, "k string, n int, h int").groupBy("k").agg(F.min_by("n", "h"))._jdf.queryExecution().toString()
    assert "partial_min_by" in plan


def test_keys_are_forgotten_and_late_rows_left_out(spark, schema, tmp_path):
    first = run(spark, tmp_path, schema, [("a", 1, 0), ("b", 1, 100)], delay="10 HOURS")
    assert first == [("a", 1), ("b", 1)]
    # a at hour 5 is late, b is known, c is new, a at hour 101 comes after its key may have been forgotten
    second = run(spark, tmp_path, schema, [("a", 2, 5), ("b", 2, 101), ("c", 3, 95)], delay="10 HOURS")
    assert second == [("a", 1), ("b", 1), ("c", 3)]
    assert {r.k for r in spark.table(f"{schema}.seen").collect()} <= {"a", "b", "c"}


def test_a_batch_that_runs_again(spark, schema, tmp_path):
    """The same micro-batch once more: neither its rows nor its state change."""
    calls = []
    place = tmp_path

    class Stream:
        """Catches the function a stream would call."""

        writeStream = property(lambda self: self)

        def option(self, *a):
            return self

        def foreachBatch(self, f):
            calls.append(f)
            return self

        trigger = option

        def start(self):
            return None

    quality.write_first_rows(Stream(), "ts", ["k"], ["ts", "n"], f"{place}/out", f"{schema}.seen", 4, f"{place}/checkpoint")
    data = [[("a", 1, 0), ("b", 1, 0)], [("b", 2, 1), ("c", 1, 1)]]
    frames = [spark.createDataFrame([(k, n, DAY + dt.timedelta(hours=h)) for k, n, h in d], SCHEMA) for d in data]
    for batch in (0, 1, 1, 0):
        calls[0](frames[batch], batch)
    out = spark.read.option("basePath", f"{place}/out").parquet(f"{place}/out")
    assert rows(out.select("k", "n", "batch_id")) == [("a", 1, 0), ("b", 1, 0), ("c", 1, 1)]
    assert rows(spark.table(f"{schema}.seen").select("k", "batch_id")) == [("a", 0), ("b", 0), ("c", 1)]
