"""Keyed tables whose loads cost what they change: rows in hash buckets of their key.

The rows lie in a parquet table partitioned by `_bucket`, the hash of the key modulo a bucket count. A view
of the table's own name hides that column; its properties hold the keys and the count, so every load cuts
the same way. A load reads the buckets its keys fall into, finds the rows that take effect, and overwrites,
by dynamic partition overwrite, only buckets that get such a row: all other files stay as they are, and a
load that runs twice writes nothing the second time. Spark writes the new files of a bucket beside the old
and swaps them in when the whole job commits; a job that fails before leaves the old state.

Choose the count so that a bucket is some hundred megabytes at the size the table will have; `rebucket`
changes it later by one rewrite. Keys are unique, so buckets are even whatever the data. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.session import cut
from sievework.sources.sinks import latest_rows, rebalanced

BUCKET = "_bucket"
KEYS, COUNT = "sievework.keys", "sievework.buckets"


@dataclass(frozen=True)
class Layout:
    """Where the rows of a table lie."""

    table: str
    keys: tuple[str, ...]
    buckets: int

    @property
    def rows(self) -> str:
        return f"{self.table}__b{self.buckets}"

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")


def layout(spark: SparkSession, table: str) -> Layout | None:
    """The stored layout, None where there is no such table yet."""
    if not spark.catalog.tableExists(table):
        return None
    properties = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    if COUNT not in properties:
        raise ValueError(f"{table} is no table of this kind: it has no property {COUNT}")
    return Layout(table, tuple(json.loads(properties[KEYS])), int(properties[COUNT]))


def create(spark: SparkSession, table: str, schema: T.StructType, keys: list[str], buckets: int) -> Layout:
    made = Layout(table, tuple(keys), buckets)
    _make(spark, made, schema)
    _point_at(spark, made, schema.names)
    return made


def _make(spark: SparkSession, made: Layout, schema: T.StructType) -> None:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.toNullable())
    spark.sql(f"CREATE TABLE {made.rows} ({columns}, {BUCKET} INT) USING PARQUET OPTIONS ('partitionOverwriteMode' 'dynamic') PARTITIONED BY ({BUCKET})")


def _point_at(spark: SparkSession, made: Layout, names: list[str]) -> None:
    shown = ", ".join(f"`{n}`" for n in names)
    kept = json.dumps(list(made.keys)).replace("'", "\\'")
    spark.sql(f"CREATE OR REPLACE VIEW {made.table} TBLPROPERTIES ('{KEYS}' = '{kept}', '{COUNT}' = '{made.buckets}') AS SELECT {shown} FROM {made.rows}")


def _aligned(df: DataFrame, schema: T.StructType, made: Layout) -> DataFrame:
    """The table's columns in their types, so that equal keys hash alike, and their bucket."""
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]).withColumn(BUCKET, made.bucket())


def _open(df: DataFrame, table: str, keys: list[str], buckets: int) -> Layout:
    known = layout(df.sparkSession, table)
    if known is None:
        return create(df.sparkSession, table, df.schema, keys, buckets)
    if list(known.keys) != list(keys):
        raise ValueError(f"{table} is keyed by {list(known.keys)}, not {keys}")
    return known


def _buckets_of(rows: DataFrame) -> list[int]:
    """At most as many numbers as the table has buckets."""
    return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())


def _overwrite(state: DataFrame, made: Layout, names: list[str]) -> None:
    rebalanced(state.select(*names, BUCKET), BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").insertInto(made.rows)


def _same(left: str, right: str, names: list[str] | tuple[str, ...]) -> Column:
    condition = F.lit(True)
    for n in names:
        condition = condition & F.col(f"{left}.`{n}`").eqNullSafe(F.col(f"{right}.`{n}`"))
    return condition


def upsert(
    df: DataFrame, table: str, keys: list[str], buckets: int, sequence: list[str] | None = None, newest: bool = False
) -> list[int]:
    """Idempotent keyed load; the buckets it wrote.

    Rows of one load that share a key are reduced to the last by `sequence`; without one they are an error.
    A loaded row replaces the stored one of its key, with `newest` only if its sequence is not smaller.
    NULL keys match each other. `buckets` counts for a new table only; df is evaluated once.
    """
    if newest and not sequence:
        raise ValueError("the newest row needs a sequence")
    spark = df.sparkSession
    made = _open(df, table, keys, buckets)
    schema = spark.table(table).schema
    staged = cut(_aligned(latest_rows(df, keys, sequence) if sequence else df, schema, made))
    if not sequence and not staged.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise ValueError(f"rows share a key of {keys}: give a sequence that says which is the last")
    stored = spark.table(made.rows).where(F.col(BUCKET).isin(_buckets_of(staged))).alias("old")
    one_key = _same("new", "old", [BUCKET, *keys])
    rest = [c for c in schema.names if c not in keys]
    stays = _same("new", "old", rest)
    if newest:
        stays = stays | (F.struct(*[f"old.{c}" for c in sequence]) > F.struct(*[f"new.{c}" for c in sequence]))
    effective = cut(staged.alias("new").join(stored, one_key & stays, "left_anti"))
    written = _buckets_of(effective)
    if written:
        old = spark.table(made.rows).where(F.col(BUCKET).isin(written)).alias("old")
        kept = old.join(effective.select(*keys, BUCKET).alias("new"), one_key, "left_anti")
        _overwrite(kept.unionByName(effective), made, schema.names)
    return written


def rewrite(
    df: DataFrame, table: str, keys: list[str], buckets: int, fold: Callable[[DataFrame, DataFrame], DataFrame], schema: T.StructType
) -> list[int]:
    """Tables that hold several rows of a key: new state of the buckets that df's keys fall into; the buckets it wrote.

    fold(stored rows of these buckets, df) gives their whole new state, in `schema`.
    """
    spark, schema = df.sparkSession, schema.toNullable()
    made = _open(spark.createDataFrame([], schema), table, keys, buckets)
    arrived = cut(df.withColumn(BUCKET, made.bucket()))
    written = _buckets_of(arrived)
    if written:
        stored = spark.table(made.rows).where(F.col(BUCKET).isin(written)).drop(BUCKET)
        _overwrite(_aligned(fold(stored, arrived.drop(BUCKET)), schema, made), made, schema.names)
    return written


def rebucket(spark: SparkSession, table: str, buckets: int) -> None:
    """Another bucket count: all rows are written again, then the view moves and the old table goes."""
    old = layout(spark, table)
    if old is None or old.buckets == buckets:
        return
    rows = spark.table(table)
    made = Layout(table, old.keys, buckets)
    spark.sql(f"DROP TABLE IF EXISTS {made.rows}")
    _make(spark, made, rows.schema)
    _overwrite(_aligned(rows, rows.schema, made), made, rows.columns)
    _point_at(spark, made, rows.columns)
    spark.sql(f"DROP TABLE IF EXISTS {old.rows}")
