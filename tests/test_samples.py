"""Bottom-k samples and profiles that add up."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import bottomk
from sievework.operators import profile, sketches
from sievework.sources import files
from tests.conftest import rows


def smallest(values, k, seed=0):
    return sorted({v for v in values if v is not None}, key=lambda v: hashlib.md5(f"{seed}:{v}".encode()).hexdigest())[:k]


@pytest.mark.parametrize("guess", [0, 10, 10**9])
def test_values(spark, guess):
    """Whatever the guess of distinct counts, and with a third of the rows on one value."""
    rng = random.Random(guess)
    data = [(f"v{rng.randrange(3000)}" if i % 3 else "hot", rng.choice(["a", "b", None]), None) for i in range(9_000)]
    df = spark.createDataFrame(data, "x string, y string, z string").repartition(5)
    got = {r["name"]: r["sample"] for r in bottomk.values(df, {c: F.col(c) for c in df.columns}, dict.fromkeys(df.columns, guess), 6, seed=4).collect()}
    for i, c in enumerate(df.columns):
        assert got[c] == smallest([r[i] for r in data], 6, 4)


def test_no_value_is_shuffled(spark):
    """Samples come out of one row a task: no exchange by value."""
    df = spark.range(50_000).selectExpr("id", "concat('t', id) AS t")
    got = profile.profile(df, "t", approx=True, seed=2)
    plan = got._jdf.queryExecution().toString()
    assert "hashpartitioning(value" not in plan and "Expand" not in plan
    samples = {r["name"]: r["sample_values"] for r in got.collect()}
    assert samples["t"] == smallest([f"t{i}" for i in range(50_000)], 5, 2)


@pytest.mark.parametrize("partitions", [1, 9])
def test_rows(spark, partitions):
    data = [(i % 700, None if i % 11 == 0 else f"é{i % 50}") for i in range(4_000)] + [(1, "hot")] * 4_000
    df = spark.createDataFrame(data, "a long, b string").repartition(partitions)
    text = lambda r: json.dumps({"a": r[0], "b": r[1]}, separators=(",", ":"), ensure_ascii=False)
    want = sorted(data, key=lambda r: hashlib.md5(f"9:{text(r)}".encode()).hexdigest())[:333]
    assert rows(files.sample_rows(df, 333, seed=9)) == sorted(want, key=repr)
    assert files.sample_rows(df, 10_000).count() == 8_000 and files.sample_rows(df.limit(0), 5).count() == 0


def test_states_add_up(spark):
    rng = random.Random(1)
    data = [(i % 4, rng.choice([None, rng.randrange(500)]), rng.gauss(0, 1) if i % 50 else float("nan"), rng.choice("abc"), None) for i in range(6_000)]
    df = spark.createDataFrame(data, "load int, n long, x double, s string, none int")
    whole = sketches.column_states(df.drop("load"), {"load": F.lit("all")})
    parts = sketches.column_states(df.filter("load < 2"), {"load": "load"}).unionByName(sketches.column_states(df.filter("load >= 2"), {"load": "load"}))
    assert parts.count() == 16
    a, b = (
        {r["name"]: r for r in sketches.profiles(sketches.unite(s), [0.5]).collect()} for s in (whole, parts)
    )
    for name in ("n", "x", "s", "none"):
        for c in ("row_count", "null_count", "min_num", "max_num"):
            assert a[name][c] == b[name][c], (name, c)
        assert b[name]["distinct_count"] == pytest.approx(a[name]["distinct_count"], rel=3 * sketches.RELATIVE_ERROR)
    known = [r[1] for r in data if r[1] is not None]
    assert b["n"]["avg_num"] == pytest.approx(sum(known) / len(known), rel=1e-12) and (b["n"]["min_num"], b["n"]["max_num"]) == (min(known), max(known))
    assert abs(b["n"]["distinct_count"] / len(set(known)) - 1) < 3 * sketches.RELATIVE_ERROR
    middle = b["n"]["quantiles"][0]
    assert sum(v < middle for v in known) / len(known) <= 0.5 + sketches.RANK_ERROR and sum(v <= middle for v in known) / len(known) >= 0.5 - sketches.RANK_ERROR
    assert b["none"]["quantiles"] is None and b["none"]["null_pct"] == 1.0 and b["s"]["distinct_count"] == 3


def test_states_by_load(spark):
    df = spark.createDataFrame([("jan", 1), ("jan", 2), ("feb", 7)], "month string, n int")
    by = sketches.unite(sketches.column_states(df, {"month": "month"}), by=["month"])
    assert rows(sketches.profiles(by, [0.5], by=["month"]).select("month", "name", "row_count", "max_num")) == [("feb", "n", 1, 7.0), ("jan", "n", 2, 2.0)]
    assert sketches.unite(sketches.column_states(df.limit(0), {"month": "month"})).collect() == []
