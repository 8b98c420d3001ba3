"""Shards along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to 2^bits bins at its own quantiles, so a skewed dimension still uses the whole
grid; a text dimension is first read as a number from the bytes after the prefix that all its values share.
The bins are the coordinates of a cell, its place on the Hilbert curve the sort key, and runs of the sorted
rows become shards. Neighbours on the curve are neighbours in the grid, so a file holds a narrow range of
every dimension and its min/max statistics prune on each of them.

Laws: `bytes` cuts where the running size passes k/shards of the total, so a shard is off the mean by less
than its largest row; `rows` cuts by rank, so counts differ by one at most. Cells of any size are cut, also
between equal texts: the order goes on by id inside a cell.

NULL has bin 0, as the smallest value has. Rows with a NULL id come first in their cell, rows that share an
id in the order of the scan. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.common import rows_of, with_prefix_sums

TEXT_BYTES = 7
ACCURACY = 10_000


def text_number(value: Column, skip: int) -> Column:
    """The TEXT_BYTES bytes after the first `skip`, as one big-endian number."""
    raw = F.hex(F.substring(value.cast("binary"), skip + 1, TEXT_BYTES))
    return F.conv(F.rpad(raw, 2 * TEXT_BYTES, "0"), 16, 10).cast("long")


def shared_prefix(low: str | None, high: str | None) -> int:
    """How many bytes all values between low and high begin with alike."""
    a, b = (low or "").encode(), (high or "").encode()
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def numbers_of(df: DataFrame, dimensions: list[str]) -> list[Column]:
    texts = [d for d in dimensions if isinstance(df.schema[d].dataType, T.StringType)]
    ends = df.agg(*[f(d).alias(f"{n}{i}") for i, d in enumerate(texts) for n, f in (("lo", F.min), ("hi", F.max))]).first() if texts else {}
    skips = {d: shared_prefix(ends[f"lo{i}"], ends[f"hi{i}"]) for i, d in enumerate(texts)}
    return [text_number(F.col(d), skips[d]) if d in skips else F.col(d).cast("double") for d in dimensions]


def binned(df: DataFrame, dimensions: list[str], bits: int) -> DataFrame:
    """df with columns _d0, _d1, ...: the bin of each dimension. Only the quantiles reach the driver."""
    numbered = df.withColumns({f"_n{i}": c for i, c in enumerate(numbers_of(df, dimensions))})
    cuts = [k / (1 << bits) for k in range(1, 1 << bits)]
    bounds = numbered.agg(*[F.percentile_approx(f"_n{i}", cuts, ACCURACY).alias(f"q{i}") for i in range(len(dimensions))]).first()
    bins = {}
    for i in range(len(dimensions)):
        steps = sorted(set(bounds[f"q{i}"] or []))
        above = [F.when(F.col(f"_n{i}") > b, 1).otherwise(0) for b in steps]
        bins[f"_d{i}"] = sum(above, F.lit(0)).cast("int")
    return numbered.withColumns(bins).drop(*[f"_n{i}" for i in range(len(dimensions))])


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Place on the curve of each point: the axes-to-transpose method of Skilling (2004), on whole arrays."""
    x = [a.astype(np.int64).copy() for a in axes]
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    q = top
    while q > 1:
        flips = np.where((x[n - 1] & q) > 0, flips ^ (q - 1), flips)
        q >>= 1
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ flips) >> bit) & 1)
    return out


def shard(df: DataFrame, dimensions: list[str], shards: int, law: str = "bytes", bits: int = 4,
          id_col: str = "doc_id", size: Column | None = None, carry: dict[str, Column] | None = None) -> DataFrame:
    """id, size, the carried columns, cell (place on the curve), shard and slot (place in the shard)."""
    if law not in ("bytes", "rows"):
        raise ValueError(f"law '{law}' is neither bytes nor rows")
    if bits * len(dimensions) > 62:
        raise ValueError("bits x dimensions must not pass 62")
    carry = carry or {}
    slim = rows_of(df, **{f"_x{i}": d for i, d in enumerate(dimensions)}, _id=id_col, size=size if size is not None else F.lit(1),
                   **{f"_c_{k}": c for k, c in carry.items()})
    grid = binned(slim, [f"_x{i}" for i in range(len(dimensions))], bits)

    @F.pandas_udf("long")
    def cell(frame: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index([frame[c].to_numpy() for c in frame], bits))

    placed = grid.select(
        "_id", F.col("size").cast("long").alias("size"), *[f"_c_{k}" for k in carry], F.lit(1).cast("long").alias("_one"),
        cell(F.struct(*[f"_d{i}" for i in range(len(dimensions))])).alias("cell"),
    )
    run = with_prefix_sums(placed, ["cell", "_id"], {"_before": "size", "_rank": "_one"})
    total, rows = run.agg(F.sum("size"), F.count(F.lit(1))).first()
    by = (F.col("_before") + F.col("size") / 2, total) if law == "bytes" else (F.col("_rank"), rows)
    # Exact integers for the rank, so counts differ by one at most.
    at = F.floor(by[0] * shards / F.lit(float(by[1] or 1))) if law == "bytes" else F.expr(f"_rank * {shards} div {rows or 1}")
    cut = run.withColumn("shard", F.least(at.cast("int"), F.lit(shards - 1)))
    # Shards are runs, so a shard's first rank is the least in it: `shards` numbers.
    first = {r["shard"]: r["f"] for r in cut.groupBy("shard").agg(F.min("_rank").alias("f")).collect()}
    begin = F.element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), F.col("shard")) if first else F.lit(0)
    return cut.select(
        F.col("_id").alias(id_col), "size", *[F.col(f"_c_{k}").alias(k) for k in carry], "cell", "shard",
        (F.col("_rank") - begin).cast("long").alias("slot"),
    )


def write(df: DataFrame, dimensions: list[str], shards: int, folder: str, law: str = "bytes", bits: int = 4, id_col: str = "doc_id", size: Column | None = None) -> None:
    """The rows of df as parquet, a folder `_shard=k` for each shard, in curve order (column _slot).

    The rows are shuffled once, whole, into the ranges that the shards are cut from, and written from there. A
    reader that filters on a dimension skips the files, and the row groups, whose min/max lie outside.
    """
    placed = shard(df, dimensions, shards, law, bits, id_col, size, carry={"row": F.struct(*[df[c] for c in df.columns])})
    rows = placed.select(F.col("shard").alias("_shard"), F.col("slot").alias("_slot"), "row.*")
    rows.sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(folder)


def extents(spark: SparkSession, folder: str, dimensions: list[str]) -> DataFrame:
    """_shard, rows, and <dimension>_min and _max: what the shards written there can be skipped by."""
    ends = [f(d).alias(f"{d}_{name}") for d in dimensions for name, f in (("min", F.min), ("max", F.max))]
    return spark.read.parquet(folder).groupBy("_shard").agg(F.count(F.lit(1)).alias("rows"), *ends)
