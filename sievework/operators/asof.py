"""As-of joins: for each row, the history row of its key that was valid at its time.

Validity intervals are cut at bucket edges (months, say), so a row and its interval meet by an equi join on
key and bucket and one comparison inside. Nothing is listed per key and day, and a hot key's rows are dealt
out by bucket. An interval that is still open is cut at the last asked time, so the cut history has at most
one row per interval and one more per bucket a key is asked in range of. Several histories are joined over
one partitioning of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH", "year": "INTERVAL 1 YEAR"}


def _bucket(at: Column, unit: str) -> Column:
    return F.date_trunc(unit, at).cast("timestamp_ntz")


def pieces(history: DataFrame, begin: str, end: str, first: Column, last: Column, unit: str) -> DataFrame:
    """history once per bucket it is valid in (column _bucket), between the first and the last asked time."""
    if unit not in STEPS:
        raise ValueError(f"choose a bucket from {list(STEPS)}")
    start = F.col(begin).cast("timestamp_ntz")
    stop = F.coalesce(F.least(F.col(end).cast("timestamp_ntz"), last), last)
    asked = history.where((start <= last) & (F.col(end).isNull() | (F.col(end) > first)) & (F.col(end).isNull() | (F.col(end) > F.col(begin))))
    edges = F.sequence(_bucket(F.greatest(start, first), unit), _bucket(stop, unit), F.expr(STEPS[unit]))
    return asked.withColumn("_bucket", F.explode(edges))


def as_of(
    rows: DataFrame, histories: dict[str, DataFrame], keys: list[str], at: str, columns: dict[str, list[str]], unit: str = "month",
    begin: str = "load_date", end: str = "load_end_date",
) -> DataFrame:
    """rows with, for each history, its `columns` as <name>_<column>: of the row valid at `at` (begin included, end not), else NULL.

    Intervals of a key do not overlap. Rows without a key or a time find nothing; no row is lost or doubled.
    """
    time = F.col(at).cast("timestamp_ntz")
    bounds = rows.agg(F.min(time).alias("first"), F.max(time).alias("last")).first()
    out = rows.withColumn("_bucket", _bucket(time, unit)).withColumn("_at", time)
    for name, history in histories.items():
        if bounds["first"] is None:
            out = out.select("*", *[F.lit(None).cast(history.schema[c].dataType).alias(f"{name}_{c}") for c in columns[name]])
            continue
        narrow = pieces(history, begin, end, F.lit(bounds["first"]).cast("timestamp_ntz"), F.lit(bounds["last"]).cast("timestamp_ntz"), unit).select(
            *[F.col(k).alias(f"_{k}") for k in keys], F.col("_bucket").alias("_piece"),
            F.col(begin).cast("timestamp_ntz").alias("_begin"), F.col(end).cast("timestamp_ntz").alias("_end"), *[F.col(c).alias(f"{name}_{c}") for c in columns[name]],
        )
        valid = (F.col("_at") >= F.col("_begin")) & (F.col("_end").isNull() | (F.col("_at") < F.col("_end")))
        for k in keys:
            valid = valid & (F.col(k) == F.col(f"_{k}"))
        out = out.join(narrow, valid & (F.col("_bucket") == F.col("_piece")), "left").drop("_piece", "_begin", "_end", *[f"_{k}" for k in keys])
    return out.drop("_bucket", "_at")
