"""Bucketed tables: what a load writes, and that its outcome is that of one whole load."""

import os

import pytest

from sievework.sources import buckets
from tests.conftest import rows

KEYS = ["a", "b"]


def files(spark, table):
    """Path -> modification time of the files of each bucket."""
    made = buckets.layout(spark, table)
    out = {}
    for uri in spark.table(made.rows).inputFiles():
        path = uri.removeprefix("file://")
        out[path] = os.stat(path).st_mtime_ns
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "a long, b string, n int, v string")


@pytest.fixture
def target(schema):
    return f"{schema}.state"


def test_other_buckets_keep_their_files(spark, target):
    first = [(i, None if i % 5 == 0 else str(i), 1, "old") for i in range(400)]
    assert buckets.upsert(frame(spark, first), target, KEYS, 32) == list(range(32))
    before = files(spark, target)
    changed = [(7, "7", 2, "new"), (10, None, 2, "new"), (1000, "x", 1, None)]
    written = buckets.upsert(frame(spark, changed), target, KEYS, 99)
    after = files(spark, target)
    assert 1 <= len(written) <= 3
    touched = tuple(f"/_bucket={b}/" for b in written)
    same = {p: t for p, t in before.items() if not any(x in p for x in touched)}
    assert same and same == {p: t for p, t in after.items() if not any(x in p for x in touched)}
    assert all(p not in after for p in before if any(x in p for x in touched))
    want = {(a, b): (a, b, n, v) for a, b, n, v in first} | {(a, b): (a, b, n, v) for a, b, n, v in changed}
    assert rows(spark.table(target)) == sorted(want.values(), key=repr)
    assert buckets.upsert(frame(spark, changed), target, KEYS, 32) == [] and files(spark, target) == after


def test_newest_wins_whatever_the_order(spark, target):
    buckets.upsert(frame(spark, [(1, "x", 5, "e"), (1, "x", 6, "f"), (2, "x", 1, "a")]), target, KEYS, 4, ["n"], newest=True)
    assert buckets.upsert(frame(spark, [(1, "x", 4, "late")]), target, KEYS, 4, ["n"], newest=True) == []
    buckets.upsert(frame(spark, [(2, "x", 2, "b"), (3, None, None, "c")]), target, KEYS, 4, ["n"], newest=True)
    assert rows(spark.table(target)) == sorted([(1, "x", 6, "f"), (2, "x", 2, "b"), (3, None, None, "c")], key=repr)
    with pytest.raises(ValueError):
        buckets.upsert(frame(spark, [(1, "x", 4, "y")]), target, KEYS, 4, newest=True)


def test_types_follow_the_table_and_shared_keys_are_errors(spark, target):
    buckets.upsert(frame(spark, [(1, "x", 1, "a")]), target, KEYS, 8)
    narrow = spark.createDataFrame([(1, "x", 2, "b")], "a int, b string, n bigint, v string")
    buckets.upsert(narrow, target, KEYS, 8)
    assert rows(spark.table(target)) == [(1, "x", 2, "b")]
    with pytest.raises(ValueError, match="share a key"):
        buckets.upsert(frame(spark, [(1, "x", 1, "a"), (1, "x", 2, "a")]), target, KEYS, 8)
    with pytest.raises(ValueError, match="keyed by"):
        buckets.upsert(frame(spark, []), target, ["a"], 8)


def test_rebucket_and_empty_loads(spark, target):
    assert buckets.upsert(frame(spark, []), target, KEYS, 4) == [] and spark.table(target).count() == 0
    data = [(i, str(i), i, "v") for i in range(100)]
    buckets.upsert(frame(spark, data), target, KEYS, 4)
    buckets.rebucket(spark, target, 16)
    assert buckets.layout(spark, target).buckets == 16 and rows(spark.table(target)) == sorted(data, key=repr)
    assert not spark.catalog.tableExists(f"{target}__b4")
    assert buckets.upsert(frame(spark, data), target, KEYS, 4) == []


def test_other_tables_are_not_taken(spark, schema):
    spark.range(3).write.saveAsTable(f"{schema}.plain")
    with pytest.raises(ValueError, match="no table of this kind"):
        buckets.upsert(spark.range(3), f"{schema}.plain", ["id"], 4)
