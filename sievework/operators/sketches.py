"""Profiles that can be added up: per load and column, counts and sketches that unite without the rows.

`column_states` gives a row per load and column: rows, NULLs, extremes and sum of numbers, a HyperLogLog
sketch of the values and a KLL sketch of the numbers. It is one pass of partial aggregates; no value is
shuffled. Kept in a table, the states of old loads are united with those of new ones by `unite`, so the
profile of the whole costs a few kilobytes a load and column, whatever the loads held.

Errors are those of the sketches: distinct counts have a relative standard error of 1.04 / sqrt(2^LOG_K),
0.8 % at LOG_K 14; ranks of quantiles are within RANK_ERROR with about 99 %. Extremes and sums of whole
numbers and decimals (28 digits before the point, 10 after) are exact. NaN counts as a value, not as a number.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.operators.profile import _as_text, _family

#: Sizes of the sketches, and the errors that go with them.
LOG_K, KLL_K = 14, 800
RELATIVE_ERROR = 1.04 / math.sqrt(1 << LOG_K)
RANK_ERROR = 0.0042

EXACT = "decimal(38,10)"


def _number(c: Column, family: str) -> Column:
    """The number a KLL sketch takes."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d) if family == "fraction" else d


def column_states(df: DataFrame, load: dict[str, Column | str]) -> DataFrame:
    """load columns, ordinal, name, data_type, family, rows, nulls, low, high, total, distinct_sketch, number_sketch.

    load: what tells loads apart, as literals or columns of df (a month, a batch id). low, high and total are
    texts of the exact values; doubles are summed as doubles.
    """
    marks = {n: (df[c] if isinstance(c, str) else c) for n, c in load.items()}
    states = []
    fields = [f for f in df.schema.fields if f.name not in {c for c in load.values() if isinstance(c, str)}]
    for i, f in enumerate(fields):
        c, family = F.col(f"`{f.name}`"), _family(f.dataType)
        none = F.lit(None)
        number = _number(c, family) if family != "other" else None
        exact = c.cast(EXACT) if family != "fraction" else number
        value = c.cast("bigint") if isinstance(f.dataType, T.IntegralType) else _as_text(f)
        states.append(
            F.struct(
                F.lit(i).alias("ordinal"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(family).alias("family"),
                F.count("*").alias("rows"), F.count_if(c.isNull()).alias("nulls"),
                (none if number is None else F.min(exact)).cast("string").alias("low"),
                (none if number is None else F.max(exact)).cast("string").alias("high"),
                (none if number is None else F.sum(exact)).cast("string").alias("total"),
                F.hll_sketch_agg(value, F.lit(LOG_K)).alias("distinct_sketch"),
                (none.cast("binary") if number is None else F.kll_sketch_agg_double(number, F.lit(KLL_K))).alias("number_sketch"),
            )
        )
    stacked = df.groupBy(*[c.alias(n) for n, c in marks.items()]).agg(F.array(*states).alias("states"))
    return stacked.select(*marks, F.inline("states"))


def unite(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """States of many loads as those of one; `by` keeps some of the load columns."""

    def best(agg: Callable[[Column], Column], c: str) -> Column:
        """Extremes and sums in the exact type of the family."""
        whole, fraction = F.col(c).cast(EXACT), F.col(c).cast("double")
        is_fraction = F.col("family") == "fraction"
        return F.coalesce(agg(F.when(~is_fraction, whole)).cast("string"), agg(F.when(is_fraction, fraction)).cast("string")).alias(c)

    has_numbers = F.when(F.col("number_sketch").isNotNull(), F.col("number_sketch"))
    return states.groupBy(*(by or []), "name").agg(
        F.min("ordinal").alias("ordinal"), F.max_by("data_type", "rows").alias("data_type"), F.max("family").alias("family"),
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), best(F.min, "low"), best(F.max, "high"), best(F.sum, "total"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double(has_numbers).alias("number_sketch"),
    )


def profiles(states: DataFrame, quantiles: list[float], by: list[str] | None = None) -> DataFrame:
    """by, ordinal, name, data_type, row_count, null_count, null_pct, distinct_count, min_num, max_num, avg_num, quantiles."""
    known = F.col("rows") - F.col("nulls")
    measured = (F.col("family") != "other") & F.col("low").isNotNull()
    at = F.array(*[F.lit(float(q)) for q in quantiles])
    return states.select(
        *(by or []), "ordinal", "name", "data_type", F.col("rows").alias("row_count"), F.col("nulls").alias("null_count"),
        F.bround(F.col("nulls") / F.greatest(F.col("rows"), F.lit(1)), 4).alias("null_pct"),
        F.hll_sketch_estimate("distinct_sketch").alias("distinct_count"),
        F.col("low").cast("double").alias("min_num"), F.col("high").cast("double").alias("max_num"),
        F.when(measured, F.col("total").cast("double") / known).alias("avg_num"),
        F.when(measured, F.kll_sketch_get_quantile_double("number_sketch", at)).alias("quantiles"),
    )
