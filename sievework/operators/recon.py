"""Pipeline tests: compare a source with a target, or a run with its repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row: both counts and their difference."""
    sides = source.agg(F.count("*").alias("n")).withColumn("side", F.lit("s")).unionByName(
        target.agg(F.count("*").alias("n")).withColumn("side", F.lit("t"))
    )
    return sides.agg(
        F.sum(F.when(F.col("side") == "s", F.col("n"))).alias("source_rows"),
        F.sum(F.when(F.col("side") == "t", F.col("n"))).alias("target_rows"),
    ).withColumn("difference", F.abs(F.col("source_rows") - F.col("target_rows")))


def measures(
    source: DataFrame, target: DataFrame, keys: list[str], sums: dict[str, Column | str], tolerance: float = 0
) -> DataFrame:
    """Keys whose summed measures differ by more than the tolerance, or that one side lacks.

    Both sides are summed per key before they meet. Measures should be exact types (decimals).
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        totals = [F.sum(F.expr(e) if isinstance(e, str) else e).alias(f"{m}_{name}") for m, e in sums.items()]
        return df.groupBy(*keys).agg(F.lit(True).alias(f"in_{name}"), *totals)

    joined = None
    s, t = side(source, "source").alias("s"), side(target, "target").alias("t")
    for key in keys:
        same = F.col(f"s.{key}").eqNullSafe(F.col(f"t.{key}"))
        joined = same if joined is None else joined & same
    both = s.join(t, joined, "full_outer")
    off = F.col("in_source").isNull() | F.col("in_target").isNull()
    for m in sums:
        a, b = F.col(f"{m}_source"), F.col(f"{m}_target")
        off = off | ~F.coalesce(F.abs(a - b) <= F.lit(tolerance), a.isNull() & b.isNull())
    return both.filter(off).select(
        *[F.coalesce(f"s.{k}", f"t.{k}").alias(k) for k in keys],
        *[c for m in sums for c in (f"{m}_source", f"{m}_target")],
    )


def row_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows whose number of copies differs; copies > 0 means more in `first`.

    Both directions of EXCEPT ALL in one shuffle. Empty for an idempotent job.
    """
    names = first.columns
    signed = first.withColumn("_sign", F.lit(1)).unionByName(second.select(*names).withColumn("_sign", F.lit(-1)))
    return signed.groupBy(*names).agg(F.sum("_sign").alias("copies")).filter("copies <> 0")
