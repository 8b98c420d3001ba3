"""Writers: tables, versioned tables, result registries, JSON and CSV files, DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOAD_STRATEGIES = ("MERGE", "APPEND", "FULL_REFRESH")

RUN_LOG = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("agent_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("token_prompt", T.LongType()),
        T.StructField("token_completion", T.LongType()),
        T.StructField("token_total", T.LongType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("duration_s", T.DoubleType()),
        T.StructField("error", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)


def rebalanced(df: DataFrame, *partition_by: str) -> DataFrame:
    """Let AQE even out file sizes before a write: split the large partitions, join the small."""
    return df.hint("rebalance", *partition_by) if partition_by else df.hint("rebalance")


def full_refresh(df: DataFrame, table: str, fmt: str = "parquet") -> None:
    rebalanced(df).write.format(fmt).mode("overwrite").saveAsTable(table)


def append(df: DataFrame, table: str, fmt: str = "parquet") -> None:
    rebalanced(df).write.format(fmt).mode("append").saveAsTable(table)


def upserted(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows whose key is not in source, plus source. NULL keys match each other."""
    marks = source.select(*keys).distinct().alias("s")
    condition = None
    for key in keys:
        same = F.col(f"t.{key}").eqNullSafe(F.col(f"s.{key}"))
        condition = same if condition is None else condition & same
    kept = target.alias("t").join(marks, condition, "left_anti")
    return kept.unionByName(source.select(*target.columns))


def versions(spark: SparkSession, table: str) -> list[int]:
    schema, _, name = table.rpartition(".")
    stem = f"{name}__v"
    found = spark.catalog.listTables(schema) if schema else spark.catalog.listTables()
    return sorted(int(t.name[len(stem):]) for t in found if t.name.startswith(stem) and t.name[len(stem):].isdigit())


def write_version(df: DataFrame, table: str, fmt: str = "parquet") -> str:
    """Write df as the next version of `table` and point the view at it last.

    Readers of the view see the old state until the new one is whole. The version before is kept,
    older ones are dropped. One writer at a time.
    """
    spark = df.sparkSession
    known = versions(spark, table)
    name = f"{table}__v{(known[-1] if known else 0) + 1}"
    rebalanced(df).write.format(fmt).mode("errorifexists").saveAsTable(name)
    spark.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM {name}")
    for old in known[:-1]:
        spark.sql(f"DROP TABLE IF EXISTS {table}__v{old}")
    return name


def latest_rows(df: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """One row per key, the last by sequence. Hot keys are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*sequence)).alias("r"))
    return last.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in df.columns])


def upsert(df: DataFrame, table: str, keys: list[str], sequence: list[str] | None = None, fmt: str = "parquet") -> None:
    """Idempotent keyed load into a versioned table: last load of a key wins.

    Rows of one load that share a key are reduced to the last by `sequence`; without one they are an error.
    A file format without MERGE has to write the whole state again; keep large targets in a
    format with row-level operations and use `merge` there.
    """
    spark = df.sparkSession
    if sequence:
        df = latest_rows(df, keys, sequence)
    elif not df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise ValueError(f"rows share a key of {keys}: give a sequence that says which is the last")
    known = versions(spark, table)
    state = upserted(spark.table(f"{table}__v{known[-1]}"), df, keys) if known else df
    write_version(state, table, fmt)


def merge(df: DataFrame, table: str, keys: list[str]) -> None:
    """Row-level MERGE, for tables whose format supports it."""
    condition = None
    for key in keys:
        same = F.expr(f"`{table.rpartition('.')[2]}`.`{key}` <=> source.`{key}`")
        condition = same if condition is None else condition & same
    df.alias("source").mergeInto(table, condition).whenMatched().updateAll().whenNotMatched().insertAll().merge()


def load(df: DataFrame, table: str, strategy: str, keys: list[str] | None = None, sequence: list[str] | None = None, fmt: str = "parquet") -> None:
    """Load by the entity's strategy."""
    if strategy == "FULL_REFRESH":
        full_refresh(df, table, fmt)
    elif strategy == "APPEND":
        append(df, table, fmt)
    elif strategy == "MERGE":
        if not keys:
            raise ValueError("MERGE needs keys")
        upsert(df, table, keys, sequence, fmt)
    else:
        raise ValueError(f"unknown load strategy '{strategy}', choose from {list(LOAD_STRATEGIES)}")


def register_results(results: DataFrame, table: str, timestamp: str) -> None:
    """Append rows as JSON text to a result registry."""
    registry = results.select(
        F.to_json(F.struct(*results.columns)).alias("result_json"), F.lit(timestamp).alias("timestamp")
    )
    registry.write.mode("append").saveAsTable(table)


def write_result(df: DataFrame, path: str, fmt: str = "json") -> None:
    """JSON lines or CSV with a header."""
    if fmt == "json":
        df.write.mode("overwrite").json(path)
    elif fmt == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError("results are written as json or csv")


def ddl(table: str, schema: T.StructType, fmt: str = "parquet") -> str:
    columns = ",\n".join(
        f"  `{f.name}` {f.dataType.simpleString().upper()}{'' if f.nullable else ' NOT NULL'}" for f in schema
    )
    return f"CREATE TABLE IF NOT EXISTS {table} (\n{columns}\n) USING {fmt.upper()}"


def create_table(spark: SparkSession, table: str, schema: T.StructType, fmt: str = "parquet") -> None:
    spark.sql(ddl(table, schema, fmt))


def create_schema(spark: SparkSession, name: str, location: str | None = None) -> None:
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}{place}")


def create_run_log(spark: SparkSession, schema: str, fmt: str = "parquet") -> str:
    table = f"{schema}.run_log"
    create_table(spark, table, RUN_LOG, fmt)
    return table
