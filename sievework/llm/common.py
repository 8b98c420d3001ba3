"""Helpers the operators share: inputs by name, folders, global prefix sums, components of links."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from itertools import accumulate
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.session import cut, scratch

Batches = Iterator[pa.RecordBatch]


def rows_of(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Just the named columns, under the operator's own names. Whatever else df has cannot clash."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def documents_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return rows_of(df, doc_id=df[id_col].cast("long"), text=df[text_col].cast("string"))


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of about `limit` bytes of a text column, so long texts do not meet in memory."""
    sizes = np.diff(np.frombuffer(batch.column(column).cast(pa.large_binary()).buffers()[1], np.int64)[: len(batch) + 1 + batch.column(column).offset][batch.column(column).offset :]) if len(batch) else np.zeros(0)
    begin = total = 0
    for i, size in enumerate(sizes.tolist()):
        total += size
        if total >= limit:
            yield batch.slice(begin, i + 1 - begin)
            begin, total = i + 1, 0
    if begin < len(batch):
        yield batch.slice(begin)


def frugal(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A task's function that, when the task ends, gives back what its worker has freed. Workers serve many stages,
    and what each of them once needed would add up beside the executor's heap."""

    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Return freed memory of Arrow and, where the C library can, of Python to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def local_folder(uri: str) -> str:
    """A shared folder as a path for open() and memory maps. Only mounted folders have one."""
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"binary files are memory-mapped, so '{uri}' must be a mounted shared folder")
    return unquote(parsed.path)


def shared_folder(spark: SparkSession, label: str) -> str:
    return local_folder(scratch(spark, label))


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: later steps start there, whoever computes them."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession, items: list, schema: T.StructType | str) -> DataFrame:
    """A row per item, each in a task of its own (items are files or partitions, never rows)."""
    if not items:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(spark.sparkContext.parallelize(items, len(items)), schema)


def range_tasks(df: DataFrame, column: Column, bytes_each: int = 64 << 20) -> int:
    """Tasks for a sort of what is made of a text column: as many as shuffles have, more where that would be too much for each."""
    total = df.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bytes_each))


def with_prefix_sums(df: DataFrame, order: list[str], sums: dict[str, str], partitions: int | None = None) -> DataFrame:
    """Adds to each row, for each (new column: non-negative long column), the sum over all rows before it.

    The rows are range-sorted by `order`, with the place in the scan as the last tie break, and written to
    the checkpoint folder. Each partition's totals, a few numbers, become the partition bases; the running
    sums are then taken inside the partitions. No task sees more than its own range.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, "_place"]
    ranged = cut(
        df.withColumn("_place", F.monotonically_increasing_id())
        .repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
    )
    totals = {
        r["_part"]: [r[c] for c in sums]
        for r in ranged.groupBy("_part").agg(*[F.sum(c).alias(name) for name, c in sums.items()]).collect()
    }
    parts = sorted(totals)
    bases = {}
    for k, name in enumerate(sums):
        runs = accumulate((totals[p][k] or 0 for p in parts), initial=0)
        bases[name] = dict(zip(parts, runs))
    kept = [f for f in ranged.schema.fields if f.name not in ("_place", "_part")]
    schema = T.StructType(kept + [T.StructField(name, T.LongType()) for name in sums])

    def run(batches: Batches) -> Batches:
        at: dict[str, int] | None = None
        for batch in batches:
            if not len(batch):
                continue
            if at is None:
                part = batch.column("_part")[0].as_py()
                at = {name: bases[name][part] for name in sums}
            columns = [batch.column(f.name) for f in kept]
            for name, source in sums.items():
                values = batch.column(source).cast(pa.int64()).fill_null(0).to_numpy()
                ends = np.cumsum(values) + at[name]
                columns.append(pa.array(ends - values, pa.int64()))
                at[name] = int(ends[-1])
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept] + list(sums))

    return ranged.mapInArrow(run, schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b): the smallest node that links reach.

    Alternates large-star and small-star steps until the edges are stars. Each step groups by one end; the
    minimum is combined before the shuffle, and it comes back to the edges by a join that Spark can split
    where one node holds many edges. Each step starts from written edges.
    """
    spark = edges.sparkSession
    now = cut(
        edges.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    for _ in range(rounds):
        # Large star: every node sends its larger neighbours to its smallest one.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = cut(
            both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        )
        # Small star: every node sends its smaller neighbours, and itself, to the smallest of them.
        low = cut(large.groupBy("b").agg(F.min("a").alias("m")))
        pairs = large.join(low, "b")
        small = cut(
            pairs.where("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y"))
            .unionByName(low.select(F.col("m").alias("x"), F.col("b").alias("y")))
            .select(F.col("x").alias("a"), F.col("y").alias("b"))
            .distinct()
        )
        done = _same(small, now)
        now = small
        if done:
            break
    else:
        raise RuntimeError(f"links are not settled after {rounds} rounds")
    stars = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _same(x: DataFrame, y: DataFrame) -> bool:
    """Whether two sets of edges are equal, by their sizes and sums of hashes."""
    mark = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")]
    return x.agg(*mark).first() == y.agg(*mark).first()

