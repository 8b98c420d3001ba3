"""Data-quality checks: each rule yields one failure count, 0 means pass.

Three kinds of rule:
- row rules have a bad-row predicate; their count is `count_if(predicate)`, and the same predicate
  splits bad rows off (quarantine);
- table rules are one aggregate over the table;
- joined rules need a shuffle of their own: reference look-ups, duplicate rows, load variance.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.ordered import with_neighbour

FRESH_HOURS = 25


@dataclass(frozen=True)
class Rule:
    table: str
    rule_type: str
    column: str | None = None  # several names are joined with commas
    priority: str = "P2"
    params: dict = field(default_factory=dict)
    rule_id: str = ""
    fail_action: str = "alert"

    @property
    def columns(self) -> list[str]:
        return [c.strip() for c in self.column.split(",")] if self.column else []

    def values(self, name: str = "values") -> list:
        given = self.params[name]
        return json.loads(given) if isinstance(given, str) else list(given)


def _number(text) -> Column:
    return F.lit(Decimal(str(text)))


def _instant(as_of: str | datetime) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def _type_max(dtype: T.DataType) -> Column:
    bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
    for kind, n in bits.items():
        if isinstance(dtype, kind):
            return F.lit(2 ** (n - 1) - 1).cast(dtype)
    if isinstance(dtype, T.DecimalType):
        return F.lit(Decimal(10**dtype.precision - 1).scaleb(-dtype.scale)).cast(dtype)
    if isinstance(dtype, T.DoubleType):
        return F.lit(1.7976931348623157e308)
    raise ValueError(f"NUMERIC_MAX does not apply to {dtype.simpleString()}")


def _outside(c: Column, low: Column | None, high: Column | None) -> Column:
    parts = ([c < low] if low is not None else []) + ([c > high] if high is not None else [])
    if not parts:
        raise ValueError("a range needs min or max")
    return parts[0] if len(parts) == 1 else parts[0] | parts[1]


def _range(c: Column, rule: Rule, **_) -> Column:
    low, high = (rule.params.get(side) for side in ("min", "max"))
    return _outside(c, None if low is None else _number(low), None if high is None else _number(high))


def _length(c: Column, rule: Rule, **_) -> Column:
    low, high = (rule.params.get(side) for side in ("min", "max"))
    return _outside(
        F.length(c), None if low is None else F.lit(int(low)), None if high is None else F.lit(int(high))
    )


ROW_RULES: dict[str, Callable[..., Column]] = {
    "NOT_NULL": lambda c, rule, **_: c.isNull(),
    "COMPLETENESS": lambda c, rule, **_: c.isNull(),
    "RANGE_CHECK": _range,
    "LENGTH_CHECK": _length,
    "REGEX_PATTERN": lambda c, rule, **_: ~c.rlike(rule.params["pattern"]),
    "LIKE_PATTERN": lambda c, rule, **_: ~c.like(rule.params["pattern"]),
    "ENUM_CHECK": lambda c, rule, **_: ~c.isin(rule.values()),
    "DATE_FORMAT": lambda c, rule, **_: c.isNotNull() & F.try_to_timestamp(c, F.lit(rule.params["format"])).isNull(),
    "FUTURE_TIMESTAMP": lambda c, rule, as_of, **_: c > _instant(as_of),
    "RECORD_SOURCE": lambda c, rule, **_: c.isNull() | (F.trim(c) == ""),
    "SPECIAL_CHARACTERS": lambda c, rule, **_: c.rlike(r"[^\t\n\r\x20-\x7E]"),
    "NUMERIC_MAX": lambda c, rule, dtype, **_: c == _type_max(dtype),
}


def _freshness(rule: Rule, as_of, **_) -> Column:
    hours = int(rule.params.get("hours", FRESH_HOURS))
    limit = _instant(as_of) - F.make_dt_interval(hours=F.lit(hours))
    return F.when(F.max(F.col(rule.columns[0]).cast("timestamp_ntz")) < limit, 1).otherwise(0)


def _ratio(rule: Rule, **_) -> Column:
    share = F.count(rule.columns[0]) / F.nullif(F.count("*"), F.lit(0))
    return F.when(share < F.lit(float(rule.params["threshold"])), 1).otherwise(0)


TABLE_RULES: dict[str, Callable[..., Column]] = {
    "ROW_COUNT": lambda rule, **_: F.when(F.count("*") <= int(rule.params.get("min", 0)), 1).otherwise(0),
    "EMPTY_SOURCE": lambda rule, **_: F.when(F.count("*") == 0, 1).otherwise(0),
    "ALL_NULL": lambda rule, **_: F.when((F.count("*") > 0) & (F.count(rule.columns[0]) == 0), 1).otherwise(0),
    "FRESHNESS": _freshness,
    "COMPLETENESS_RATIO": _ratio,
}


def bad_row(rule: Rule, df: DataFrame, as_of=None) -> Column:
    """Predicate of a row rule; NULL (rule does not apply) counts as good."""
    name = rule.columns[0]
    return ROW_RULES[rule.rule_type](F.col(name), rule, as_of=as_of, dtype=df.schema[name].dataType)


def aggregate(rule: Rule, df: DataFrame, as_of=None) -> Column:
    """Failure count of a row or table rule as an aggregate expression."""
    if rule.rule_type in ROW_RULES:
        return F.count_if(bad_row(rule, df, as_of))
    return TABLE_RULES[rule.rule_type](rule, as_of=as_of).cast("bigint")


def missing_parents(
    child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str], nulls_fail: bool = True
) -> DataFrame:
    """Child keys the parent lacks, with their row counts.

    Child rows are counted per key before the join, so a hot key is one row in it; the join then
    reuses that partitioning. `nulls_fail` counts rows with a NULL key as orphans.
    """
    if not nulls_fail:
        child = child.dropna(subset=columns)
    names = [f"k{i}" for i in range(len(columns))]
    keys = child.groupBy(*[F.col(c).alias(n) for c, n in zip(columns, names)]).agg(F.count("*").alias("n"))
    known = parent.select(*[F.col(c).alias(n) for c, n in zip(parent_columns, names)])
    return keys.join(known, names, "left_anti")


def _referential(rule: Rule, tables: dict[str, DataFrame], nulls_fail: bool) -> DataFrame:
    parent = tables[rule.params["parent"]]
    parent_columns = [c.strip() for c in rule.params.get("parent_column", rule.column).split(",")]
    lost = missing_parents(tables[rule.table], rule.columns, parent, parent_columns, nulls_fail)
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failures"))


def _unique(rule: Rule, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows beyond the first of each key. A plain column counts each NULL as a failure; a key with a NULL
    part is a key. Only keys and their counts move, and no other rule's counters with them."""
    counts = tables[rule.table].groupBy(*rule.columns).agg(F.count("*").alias("n"))
    known = F.col(rule.columns[0]).isNotNull() if len(rule.columns) == 1 else F.lit(True)
    return counts.agg(F.coalesce(F.sum(F.col("n") - F.when(known, 1).otherwise(0)), F.lit(0)).alias("failures"))


def row_digest(columns: list[str]) -> Column:
    """256 bits that stand for the values of a row: whole rows need not move to be compared."""
    return F.unhex(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))


def excess_copies(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that occur more than once, with n. Copies are counted map-side before rows move."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def _duplicate_rows(rule: Rule, tables: dict[str, DataFrame]) -> DataFrame:
    df = tables[rule.table]
    copies = excess_copies(df.select(row_digest(rule.columns or df.columns).alias("row")), ["row"])
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("failures"))


def _duplicate_business_key(rule: Rule, tables: dict[str, DataFrame]) -> DataFrame:
    return excess_copies(tables[rule.table], rule.columns).agg(F.count("*").alias("failures"))


def load_variance(df: DataFrame, load_column: str) -> DataFrame:
    """Rows per load and the share by which they changed since the load before."""
    loads = df.filter(F.col(load_column).isNotNull()).groupBy(F.col(load_column).alias("load")).agg(
        F.count("*").alias("n")
    )
    near = with_neighbour(loads, [], "load", "n", "previous", chunk=F.date_trunc("month", "load"))
    return near.withColumn("change", F.abs(F.col("n") - F.col("previous")) / F.col("previous"))


def _variance(rule: Rule, tables: dict[str, DataFrame]) -> DataFrame:
    limit = F.lit(float(rule.params["percent"]) / 100)
    changes = load_variance(tables[rule.table], rule.columns[0])
    return changes.agg(F.count_if(F.col("change") > limit).alias("failures"))


JOINED_RULES: dict[str, Callable[[Rule, dict[str, DataFrame]], DataFrame]] = {
    "UNIQUE": _unique,
    "REFERENTIAL": lambda rule, tables: _referential(rule, tables, nulls_fail=True),
    "LOOKUP": lambda rule, tables: _referential(rule, tables, nulls_fail=False),
    "DUPLICATE_ROWS": _duplicate_rows,
    "DUPLICATE_BUSINESS_KEY": _duplicate_business_key,
    "RECORD_COUNT_VARIANCE": _variance,
}

RULE_TYPES = (*ROW_RULES, *TABLE_RULES, *JOINED_RULES)
