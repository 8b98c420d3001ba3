"""Satellites by their log: every order of loads gives the history of one load."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import satlog, vault
from tests.conftest import rows

SCHEMA = "k long, d string, v string, w int, seq long"


def observed(spark, data, **more):
    df = spark.createDataFrame(data, SCHEMA)
    return satlog.observe(df, "hk", ["k"], F.col("d").cast("timestamp_ntz"), ["v", "w"], "src", ["seq"], **more)


def loaded(spark, target, batches, **more):
    for batch in batches:
        satlog.load(observed(spark, batch, **more), target, "hk", 4)
    return rows(satlog.satellite(spark.table(target), "hk", chunk=more.get("chunk", "month")))


def whole(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    return rows(vault.satellite(df, "hk", ["k"], F.col("d").cast("timestamp_ntz"), ["v", "w"], "src", ["seq"], chunk=None))


def test_a_late_row_brings_a_repeat_back(spark, schema):
    a1, a3, b2 = (1, "2024-01-01", "A", 1, 1), (1, "2024-01-03", "A", 1, 2), (1, "2024-01-02", "B", 1, 3)
    got = loaded(spark, f"{schema}.log", [[a1], [a3], [b2]])
    assert [(str(r[1])[:10], str(r[2])[:10], r[5]) for r in got] == [
        ("2024-01-01", "2024-01-02", "A"), ("2024-01-02", "2024-01-03", "B"), ("2024-01-03", "None", "A"),
    ]


def test_all_orders(spark, schema):
    data = [
        (1, "2024-01-01", "A", 1, 1), (1, "2024-01-05", "B", None, 2), (1, "2024-01-20", "A", 1, 3), (1, "2024-02-02", "A", 1, 4), (1, "2024-03-01", "B", None, 5),
        (1, "2024-01-05", "C", 2, 1), (2, "2024-02-02", None, 1, 1), (2, "2024-02-03", None, 1, 2), (None, "2024-01-01", "Z", 1, 1),
    ]
    want = whole(spark, data)
    batches = [data[0::3], data[1::3], data[2::3]]
    for i, order in enumerate(itertools.permutations(batches)):
        assert loaded(spark, f"{schema}.log{i}", [*order, order[0]]) == want


@pytest.mark.parametrize("chunk", ["day", "month", "year"])
def test_random_loads(spark, schema, chunk):
    rng = random.Random(chunk)
    data = [(rng.randrange(4), f"2024-0{rng.randint(1, 4)}-{rng.randint(1, 28):02}", rng.choice("AB"), rng.choice([1, None]), i) for i in range(250)]
    batches = [[] for _ in range(4)]
    for r in data:
        batches[rng.randrange(4)].append(r)
    assert loaded(spark, f"{schema}.log", batches, chunk=chunk) == whole(spark, data)


def test_text_keys_share_a_parent(spark, schema):
    df = spark.createDataFrame([("a ", "2024-01-01", "x", 1), ("A", "2024-01-01", "y", 2)], "k string, d string, v string, seq long")
    one = satlog.observe(df, "hk", ["k"], F.col("d").cast("timestamp_ntz"), ["v"], "src", ["seq"])
    assert [r.v for r in one.collect()] == ["y"]


def test_untouched_pieces_pass(spark, schema):
    target = f"{schema}.log"
    satlog.load(observed(spark, [(1, "2024-01-01", "A", 1, 1), (1, "2024-02-01", "A", 1, 2)]), target, "hk", 4)
    log = spark.table(target)
    again = satlog.fold(log, observed(spark, [(1, "2024-02-03", "A", 1, 3)]), "hk").collect()
    assert sorted((str(r.first_seen)[:10], str(r.last_seen)[:10], len(r.seen)) for r in again) == [("2024-01-01", "2024-01-01", 1), ("2024-02-01", "2024-02-03", 2)]
    assert satlog.load(observed(spark, []), target, "hk", 4) == []
