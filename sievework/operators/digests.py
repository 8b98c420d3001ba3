"""Differences of large tables by a tree of digests: only ranges that differ are read again.

The rows of a table fall into ranges by a hash of their key. A range's digest is its row count and two sums
of row hashes: sums do not depend on order, count copies, and add up, so the digest of any node of the tree
is the sum of its children's. `digests` computes the leaves in one pass of partial aggregates (a task gives
one row per range, whatever it reads); kept beside a table they spare even that pass. `differing` compares
two trees from the root down and goes on only below nodes that differ. `difference` then reads the rows of
the differing leaves and gives both directions of EXCEPT ALL; where a table is stored in partitions by range
(`store`), files of equal ranges are not opened.

Row hashes are two 64-bit hashes of the row's values, one salted with the key's range, each summed over 128
bits; that two different sets of rows share both sums and the count is out of the question but for intent.
Doubles compare by value (-0.0 is 0.0), NULLs equal each other, and columns are matched by name and type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.session import cut

RANGE = "_range"
FANOUT = 16
DIGEST = ["n", "first", "second"]


def _levels(leaves: int) -> int:
    levels, n = 0, 1
    while n < leaves:
        levels, n = levels + 1, n * FANOUT
    if n != leaves:
        raise ValueError(f"the number of ranges is a power of {FANOUT}, not {leaves}")
    return levels


def range_of(keys: list[str], leaves: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(leaves)).cast("int")


def _values(df: DataFrame) -> list[Column]:
    """Columns in one order, in a form in which equal values are equal bytes."""
    out = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        if f.name == RANGE:
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = c + F.lit(0.0).cast(f.dataType)
        elif isinstance(f.dataType, (T.MapType, T.VariantType)):
            c = F.to_json(c)
        # a NULL leaves Spark's hash as it is, so its place is marked
        out += [F.lit(f.name), c.isNull(), c]
    return out


def with_range(df: DataFrame, keys: list[str], leaves: int) -> DataFrame:
    return df if RANGE in df.columns else df.withColumn(RANGE, range_of(keys, leaves))


def digests(df: DataFrame, keys: list[str], leaves: int) -> DataFrame:
    """_range, n, first, second: a row per range that has rows."""
    _levels(leaves)
    values = _values(df)
    rows = with_range(df, keys, leaves).select(RANGE, F.xxhash64(*values).alias("first"), F.xxhash64(F.col(RANGE), *values, F.lit(1)).alias("second"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    return rows.groupBy(RANGE).agg(F.count("*").alias("n"), wide("first").alias("first"), wide("second").alias("second"))


def differing(left: DataFrame, right: DataFrame, leaves: int) -> list[int]:
    """The ranges whose digests differ, found from the root down.

    Each level is summed from the leaves of the nodes that differ one level above; the driver sees the
    numbers of differing nodes, `leaves` at most.
    """
    levels = _levels(leaves)
    signed = left.select(RANGE, *DIGEST).unionByName(right.select(RANGE, *[(-F.col(c)).alias(c) for c in DIGEST]))
    both = cut(signed.groupBy(RANGE).agg(*[F.sum(c).alias(c) for c in DIGEST]))
    nodes = [0]
    for level in range(levels + 1):
        width = leaves // FANOUT**level
        node = F.floor(F.col(RANGE) / width).cast("int")
        own = both if level == 0 else both.where(F.floor(F.col(RANGE) / (width * FANOUT)).cast("int").isin(nodes))
        sums = own.groupBy(node.alias("node")).agg(*[F.sum(c).alias(c) for c in DIGEST])
        nodes = sorted(r["node"] for r in sums.where(" or ".join(f"{c} <> 0" for c in DIGEST)).select("node").collect())
        if not nodes:
            return []
    return nodes


def store(df: DataFrame, keys: list[str], leaves: int, path: str) -> None:
    """df partitioned by range, so that a reader of some ranges opens no others, and its digests in `<path>-digests`."""
    placed = with_range(df, keys, leaves)
    placed.hint("rebalance", RANGE).write.partitionBy(RANGE).mode("errorifexists").parquet(path)
    written = df.sparkSession.read.parquet(path)
    digests(written, keys, leaves).write.mode("errorifexists").parquet(f"{path}-digests")


def difference(
    left: DataFrame, right: DataFrame, keys: list[str], leaves: int, left_digests: DataFrame | None = None, right_digests: DataFrame | None = None
) -> DataFrame:
    """Rows whose number of copies differs, with copies > 0 where `left` has more: EXCEPT ALL both ways.

    Digests that are kept with a side are taken as they are.
    """
    names = [c for c in left.columns if c != RANGE]
    found = differing(
        digests(left, keys, leaves) if left_digests is None else left_digests,
        digests(right, keys, leaves) if right_digests is None else right_digests, leaves,
    )
    sides = []
    for df, sign in ((left, 1), (right, -1)):
        some = with_range(df, keys, leaves).where(F.col(RANGE).isin(found)) if found else with_range(df, keys, leaves).limit(0)
        sides.append(some.select(RANGE, *names).withColumn("_sign", F.lit(sign)))
    signed = sides[0].unionByName(sides[1])
    # Whole rows move only for the few ranges; copies are added up by row hash before that.
    marks = [F.xxhash64(*_values(left)).alias("_first"), F.xxhash64(F.lit(2), *_values(left)).alias("_second")]
    sums = signed.select(*marks, *names, "_sign").groupBy("_first", "_second").agg(
        F.sum("_sign").alias("copies"), F.any_value(F.struct(*names)).alias("row")
    )
    return sums.where("copies <> 0").select("row.*", "copies")
