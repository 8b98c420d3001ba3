"""Digest trees and inclusions among all columns."""

import itertools
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sievework.operators import digests, keys
from tests.conftest import rows

SCHEMA = "k long, v string, x double, t array<int>"


def made(rng, n):
    return [(rng.randrange(2_000), rng.choice(["a", None, "é", ""]), rng.choice([0.0, -0.0, 1.5, None]), rng.choice([None, [1, None]])) for _ in range(n)]


def counted(data):
    return Counter((k, v, None if x is None else abs(x) if x == 0 else x, t if t is None else tuple(t)) for k, v, x, t in data)


@pytest.mark.parametrize("leaves", [1, 16, 256])
def test_both_ways(spark, leaves):
    rng = random.Random(leaves)
    left = made(rng, 3_000) + [(7, "hot", 1.0, None)] * 1_500
    right = list(left)
    for i in rng.sample(range(len(right)), 40):
        right[i] = made(rng, 1)[0]
    right += right[:5]
    rng.shuffle(right)
    got = digests.difference(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA).select("t", "x", "v", "k").repartition(7), ["k"], leaves).collect()
    want = counted(left)
    want.subtract(counted(right))
    found = {(r.k, r.v, r.x, r.t if r.t is None else tuple(r.t)): r.copies for r in got}
    assert found == {k: n for k, n in want.items() if n} and len(found) > 20


def test_equal_tables_and_empty_ones(spark):
    rng = random.Random(3)
    df = spark.createDataFrame(made(rng, 500), SCHEMA)
    assert digests.difference(df, df.repartition(5), ["k"], 16).collect() == []
    assert digests.difference(df.limit(0), df.limit(0), ["k"], 16).collect() == []
    assert digests.difference(df, df.limit(0), ["k"], 16).agg(F.sum("copies")).first()[0] == 500
    with pytest.raises(ValueError):
        digests.difference(df, df, ["k"], 17)


def test_only_nodes_that_differ(spark):
    left = spark.range(50_000).selectExpr("id AS k", "id % 7 AS v")
    right = left.selectExpr("k", "if(k in (5, 77), 99, v) AS v")
    found = digests.differing(digests.digests(left, ["k"], 256), digests.digests(right, ["k"], 256), 256)
    want = {r[0] for r in left.where("k in (5, 77)").select(digests.range_of(["k"], 256)).collect()}
    assert set(found) == want


def test_equal_ranges_are_not_read(spark, tmp_path):
    """Every file of an equal range is spoilt after the digests are stored; the difference does not notice."""
    left = spark.range(5_000).selectExpr("id AS k", "concat('v', id) AS v")
    right = left.selectExpr("k", "if(k = 123, 'other', v) AS v")
    sides = []
    for name, df in (("l", left), ("r", right)):
        path = str(tmp_path / name)
        digests.store(df, ["k"], 16, path)
        sides.append((spark.read.schema("k long, v string, _range int").parquet(path), spark.read.parquet(f"{path}-digests")))
    (l, ld), (r, rd) = sides
    differs = left.where("k = 123").select(digests.range_of(["k"], 16)).first()[0]
    spoilt = [f for side in ("l", "r") for f in Path(tmp_path, side).glob("*/*.parquet") if f.parent.name != f"_range={differs}"]
    for f in spoilt:
        f.write_bytes(b"no parquet")
        crc = f.with_name(f".{f.name}.crc")
        if crc.exists():
            crc.write_bytes(b"")
    assert len(spoilt) >= 30
    assert rows(digests.difference(l, r, ["k"], 16, ld, rd)) == [(123, "other", -1), (123, "v123", 1)]


def plain_inclusions(tables):
    columns = {(t, c): {("s" if isinstance(v, str) else "n", v) for v in values if v is not None} for t, cs in tables.items() for c, values in cs.items()}
    return sorted((*a, *b, len(columns[a])) for a, b in itertools.permutations(columns, 2) if columns[a] and columns[a] <= columns[b])


def test_inclusions(spark):
    rng = random.Random(2)
    data = {
        "a": {"id": list(range(100)), "name": [f"n{i}" for i in range(100)], "none": [None] * 100},
        "b": {"a_id": [rng.randrange(100) for _ in range(90)] + [None] * 10, "code": [str(i) for i in range(100)], "hot": [5] * 100},
        "c": {"n": [f"n{i % 9}" for i in range(100)], "one": [7] * 100, "odd": [f"n{i}" if i else "x" for i in range(100)]},
    }
    frames = {}
    for t, cs in data.items():
        kinds = {c: "string" if any(isinstance(v, str) for v in vs) else "int" for c, vs in cs.items()}
        frames[t] = spark.createDataFrame(list(zip(*cs.values())), ", ".join(f"{c} {k}" for c, k in kinds.items())).repartition(3)
    assert rows(keys.inclusions(frames)) == plain_inclusions(data)


def test_inclusions_of_more_columns_than_a_word_has_bits(spark):
    wide = {f"t{j}": {f"c{j}_{i}": list(range(1, 2 + (i * 7 + j) % 40)) for i in range(45)} for j in range(3)}
    frames = {}
    for t, cs in wide.items():
        n = max(map(len, cs.values()))
        data = list(zip(*[v + [None] * (n - len(v)) for v in cs.values()]))
        frames[t] = spark.createDataFrame(data, ", ".join(f"{c} long" for c in cs))
    assert rows(keys.inclusions(frames)) == sorted(plain_inclusions(wide), key=repr)


def test_inclusions_compare_within_families(spark):
    df = spark.sql("SELECT 1 AS i, 1L AS l, '1' AS s, 1.0D AS d, CAST(1 AS DECIMAL(5,2)) AS m, CAST(1 AS DECIMAL(9,4)) AS m2, true AS b, array(1) AS a")
    assert {(r.from_column, r.to_column) for r in keys.inclusions({"t": df}).collect()} == {("i", "l"), ("l", "i"), ("m", "m2"), ("m2", "m")}
    assert keys.inclusions({"t": df.limit(0)}).collect() == []
