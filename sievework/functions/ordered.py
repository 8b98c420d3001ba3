"""Neighbour rows in ordered groups, without holding a hot group in one task.

With `chunk`, a coarser step of the order column such as its day, a group is cut into (key, chunk)
pieces that sort in separate tasks; only one summary row per piece meets in the key's own window.
Without it a group is one window, fit for groups of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import cut


def _cut(df: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    """Rows with their piece. As a struct it joins NULL keys too, and all steps share its partitioning."""
    return df.withColumn("_piece", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], chunk.alias("chunk")))


def _across(keys: list[str], descending: bool = False):
    """The window over the pieces of a key."""
    order = F.col("_piece.chunk").desc() if descending else F.col("_piece.chunk").asc()
    return Window.partitionBy(*[F.col(f"_piece.k{i}") for i, _ in enumerate(keys)]).orderBy(order)


def with_neighbour(
    df: DataFrame, keys: list[str], order: str, value: str, out: str, chunk: Column | None = None
) -> DataFrame:
    """Add the value of the row before each row, per key, in `order`. `value` must not be NULL."""
    if chunk is None:
        return df.withColumn(out, F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))
    rows = _cut(df, keys, chunk)
    near = F.lag(value).over(Window.partitionBy("_piece").orderBy(order))
    ends = rows.groupBy("_piece").agg(F.max_by(value, order).alias("_last"))
    beyond = ends.select("_piece", F.lag("_last").over(_across(keys)).alias("_beyond"))
    joined = rows.withColumn("_near", near).join(beyond, "_piece")
    return joined.select(*df.columns, F.coalesce("_near", "_beyond").alias(out))


def changes(
    df: DataFrame, keys: list[str], order: str, value: str, end: str, chunk: Column | None = None
) -> DataFrame:
    """Rows whose value differs from the row before, with the order of the key's next such row as `end`.

    One row per key and order is expected; `value` must not be NULL.
    """

    def differs(before: Column) -> Column:
        return ~F.col(value).eqNullSafe(before)

    if chunk is None:
        window = Window.partitionBy(*keys).orderBy(order)
        changed = df.withColumn("_before", F.lag(value).over(window)).filter(differs(F.col("_before"))).drop("_before")
        return changed.withColumn(end, F.lead(order).over(window))

    inside = Window.partitionBy("_piece").orderBy(order)
    rows = _cut(df, keys, chunk).withColumn("_before", F.lag(value).over(inside))
    first = F.col("_before").isNull()
    # per piece: its first and last value, and its first change beyond the first row
    ends = rows.groupBy("_piece").agg(
        F.min(order).alias("_first_at"),
        F.min_by(value, order).alias("_first"),
        F.max_by(value, order).alias("_last"),
        F.min(F.when(~first & differs(F.col("_before")), F.col(order))).alias("_next_inside"),
    )
    opens = ~F.col("_first").eqNullSafe(F.lag("_last").over(_across(keys)))
    ends = ends.withColumn("_opens", opens)
    starts = F.when(F.col("_opens"), F.col("_first_at")).otherwise(F.col("_next_inside"))
    later = _across(keys, descending=True).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_starts", starts).withColumn("_beyond", F.last("_starts", ignorenulls=True).over(later))

    joined = rows.join(ends.select("_piece", "_opens", "_beyond"), "_piece")
    changed = joined.filter(F.when(first, F.col("_opens")).otherwise(differs(F.col("_before"))))
    return changed.select(*df.columns, F.coalesce(F.lead(order).over(inside), F.col("_beyond")).alias(end))


def numbered(df: DataFrame, order: str, out: str) -> DataFrame:
    """df with the place of each row by `order`, from 0, over the whole table.

    Rows are sorted in ranges; the driver sees one count per range, and places are taken inside the ranges.
    """
    ranged = cut(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    sizes = {r["_range"]: r["n"] for r in ranged.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    base, begins = 0, []
    for part in sorted(sizes):
        begins.append((part, base))
        base += sizes[part]
    bases = df.sparkSession.createDataFrame(begins, "_range int, _base bigint")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return ranged.withColumn("_in", inside).join(F.broadcast(bases), "_range").withColumn(out, F.col("_base") + F.col("_in")).drop("_range", "_in", "_base")
