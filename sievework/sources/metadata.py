"""Hand-written table inventories in JSON: load, default, reject."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KNOWN_KEYS = (
    "table_name", "database", "row_count", "source_mode", "source_path", "record_source",
    "columns", "relationships",
)
COLUMN_STRUCT = (
    "STRUCT<name: STRING, data_type: STRING, nullable: BOOLEAN, null_pct: DOUBLE, "
    "distinct_count: BIGINT, sample_values: ARRAY<STRING>, is_primary_key: BOOLEAN, "
    "is_foreign_key: BOOLEAN, fk_references: STRING>"
)
EDGE_STRUCT = "STRUCT<from_column: STRING, to_table: STRING, to_column: STRING, confidence: STRING>"
TABLE_FIELDS = (
    "table_name STRING, database STRING, row_count BIGINT, record_source STRING, "
    f"columns ARRAY<{COLUMN_STRUCT}>, relationships ARRAY<{EDGE_STRUCT}>"
)


def read_inventory(spark: SparkSession, path: str, lines: bool = True) -> tuple[DataFrame, DataFrame]:
    """(tables, rejects). Each line holds one table object or an array of them; without `lines` each file does, read whole by one task."""
    raw = spark.read.text(path, wholetext=not lines).select(F.trim("value").alias("raw"))
    is_array = F.col("raw").startswith("[")
    each = F.when(is_array, F.from_json("raw", "ARRAY<STRING>")).otherwise(F.array("raw"))
    parsed = (
        raw.select(F.explode_outer(each).alias("raw"))
        .withColumn("t", F.from_json("raw", TABLE_FIELDS))
        .withColumn("all_keys", F.from_json("raw", "MAP<STRING, STRING>"))
    )
    unusable = F.exists("t.columns", lambda c: c["name"].isNull() | c["data_type"].isNull())
    reason = (
        F.when(F.col("all_keys").isNull(), "not an object or array")
        .when(F.col("t.table_name").isNull(), "missing table_name")
        .when(F.coalesce(F.size("t.columns"), F.lit(0)) <= 0, "missing or empty columns")
        .when(unusable, "column without name or data_type")
    )
    parsed = parsed.withColumn("reason", reason)

    def column(c):
        return F.struct(
            c["name"].alias("name"),
            F.lower(F.trim(c["data_type"])).alias("data_type"),
            F.coalesce(c["nullable"], F.lit(True)).alias("nullable"),
            c["null_pct"].alias("null_pct"),
            c["distinct_count"].alias("distinct_count"),
            F.coalesce(c["sample_values"], F.array().cast("array<string>")).alias("sample_values"),
            F.coalesce(c["is_primary_key"], F.lit(False)).alias("is_primary_key"),
            F.coalesce(c["is_foreign_key"], F.lit(False)).alias("is_foreign_key"),
            c["fk_references"].alias("fk_references"),
        )

    tables = parsed.filter("reason IS NULL").select(
        F.col("t.table_name").alias("table_name"),
        F.coalesce("t.database", F.lit("")).alias("database"),
        F.coalesce("t.row_count", F.lit(0)).alias("row_count"),
        F.lit("manual").alias("source_mode"),
        F.lit(None).cast("string").alias("source_path"),
        F.col("t.record_source").alias("record_source"),
        F.transform("t.columns", column).alias("columns"),
        F.coalesce("t.relationships", F.array().cast(f"array<{EDGE_STRUCT}>")).alias("relationships"),
        F.map_filter("all_keys", lambda k, _: ~k.isin(*KNOWN_KEYS)).alias("extra"),
    )
    rejects = parsed.filter("reason IS NOT NULL").select("reason", "raw")
    return tables, rejects


def explode_columns(tables: DataFrame) -> DataFrame:
    """Column inventory: one row per column."""
    return tables.select(
        "table_name", "database", "row_count", F.posexplode("columns").alias("ordinal", "c")
    ).select("table_name", "database", "row_count", "ordinal", "c.*")
