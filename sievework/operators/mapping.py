"""Source-to-target mappings: one SQL expression per target column."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIRECT_COPY = "DIRECT COPY"
DERIVED = "DERIVED"
STANDARD_COLUMNS = ("load_date", "record_source")


@dataclass(frozen=True)
class ColumnMapping:
    source_column: str
    target_column: str
    target_type: str
    rule: str = DIRECT_COPY
    nullable: bool = True


@dataclass(frozen=True)
class Mapping:
    source_table: str
    target_table: str
    columns: list[ColumnMapping] = field(default_factory=list)
    filter: str | None = None
    join: str | None = None
    join_type: str = "left"


def expression(m: ColumnMapping) -> Column:
    if m.rule == DIRECT_COPY:
        if m.source_column == DERIVED:
            raise ValueError(f"derived column {m.target_column} needs an expression")
        return F.col(m.source_column)
    if re.search(r"\bselect\b|;", m.rule, re.I):
        raise ValueError(f"mapping of {m.target_column} must be a single expression without subqueries")
    return F.expr(m.rule)


def _prepared(df: DataFrame, mapping: Mapping, other: DataFrame | None) -> DataFrame:
    df = df.alias("source")
    if mapping.join:
        if other is None:
            raise ValueError("the mapping joins a second table, none was given")
        df = df.join(other.alias("other"), F.expr(mapping.join), mapping.join_type)
    return df.filter(F.expr(mapping.filter)) if mapping.filter else df


def _standard(load_date: str, record_source: str) -> list[Column]:
    return [
        F.lit(load_date).cast("timestamp_ntz").alias("load_date"),
        F.lit(record_source).alias("record_source"),
    ]


def apply(
    df: DataFrame, mapping: Mapping, load_date: str, record_source: str, other: DataFrame | None = None
) -> DataFrame:
    """The target rows. A value that does not fit its target type becomes NULL, see `rejects`."""
    columns = [expression(m).try_cast(m.target_type).alias(m.target_column) for m in mapping.columns]
    return _prepared(df, mapping, other).select(*columns, *_standard(load_date, record_source))


def rejects(df: DataFrame, mapping: Mapping, other: DataFrame | None = None) -> DataFrame:
    """Per target column: values lost in the cast, and NULLs where none are allowed. One scan."""
    src = _prepared(df, mapping, other)
    rows = []
    for m in mapping.columns:
        value = expression(m)
        cast = value.try_cast(m.target_type)
        unwanted = F.lit(0) if m.nullable else F.count_if(cast.isNull())
        rows.append(
            F.struct(
                F.lit(m.target_column).alias("target_column"),
                F.count_if(value.isNotNull() & cast.isNull()).alias("cast_failures"),
                unwanted.cast("bigint").alias("null_failures"),
            )
        )
    return src.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def unmapped(target: T.StructType, mapping: Mapping) -> list[str]:
    """Target columns without a mapping, standard columns aside."""
    mapped = {m.target_column for m in mapping.columns} | set(STANDARD_COLUMNS)
    return [f.name for f in target if f.name not in mapped]


def from_rows(rows: DataFrame) -> Mapping:
    """A mapping document's flat rows (one per target column) as plan input."""
    found = rows.select(
        "source_table", "target_table", "source_column", "target_column", "target_data_type",
        "transformation_rule", "nullable",
    ).collect()
    if len({(r["source_table"], r["target_table"]) for r in found}) != 1:
        raise ValueError("rows of exactly one mapping are expected")
    return Mapping(
        found[0]["source_table"],
        found[0]["target_table"],
        [
            ColumnMapping(
                r["source_column"], r["target_column"], r["target_data_type"], r["transformation_rule"],
                r["nullable"] is not False,
            )
            for r in found
        ],
    )
