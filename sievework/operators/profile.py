"""Table and column profiles: one pass in native types for the numbers, one shuffle for distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions import bottomk
from sievework.session import cut
from sievework.sources import catalog, files

SAMPLES = 5
LIVE, FROM_METADATA, NO_STATS = "live", "metadata", "none"

COLUMN_INFO = "col_no STRING, ordinal INT, name STRING, data_type STRING, nullable BOOLEAN, family STRING"


def _family(dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return "whole"
    if isinstance(dtype, T.DecimalType):
        return "decimal"
    if isinstance(dtype, T.FractionalType):
        return "fraction"
    return "other"


def _as_text(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    if isinstance(field.dataType, T.BinaryType):
        return F.hex(c)
    if isinstance(field.dataType, T.TimestampType):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSSXXX")  # with its offset: two instants of a repeated hour differ
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0.0).cast(field.dataType)  # -0.0 and 0.0 are one value
    return c.cast("string")


def value_counts(df: DataFrame) -> DataFrame:
    """(col_no, value, n): every column stacked, then counted. Hot values collapse map-side."""
    text = df.select(*[_as_text(f).alias(str(i)) for i, f in enumerate(df.schema.fields)])
    stacked = text.unpivot([], text.columns, "col_no", "value")
    return stacked.groupBy("col_no", "value").agg(F.count("*").alias("n"))


def profile(
    df: DataFrame,
    name: str,
    sample_rows: int | None = None,
    approx: bool = False,
    k: int = SAMPLES,
    seed: int = 0,
) -> DataFrame:
    """One row per column: counts, null share, distinct count, samples, min/max/avg of numbers.

    With `sample_rows` the statistics describe that many rows, drawn by `seed`, while row_count is of the
    whole table. `approx` estimates the distinct counts with sketches and draws the samples by hash (the k
    values whose hashes with `seed` are smallest): two scans, and no value is shuffled.
    """
    spark = df.sparkSession
    info = spark.createDataFrame(
        [
            (str(i), i, f.name, f.dataType.simpleString(), f.nullable, _family(f.dataType))
            for i, f in enumerate(df.schema.fields)
        ],
        COLUMN_INFO,
    )
    data = df if sample_rows is None else cut(files.sample_rows(df, sample_rows, seed))
    stats = _sketched(data, k, seed) if approx else _exact(data, k)
    whole = F.col("s.rows")
    if sample_rows is not None:
        total = df.agg(F.count("*").alias("total"))
        stats = stats.withColumn("row_count", total.scalar())
        whole = F.col("s.row_count")
    share = F.bround(F.col("s.nulls") / F.greatest(F.col("s.rows"), F.lit(1)), 4)
    return (
        info.alias("i")
        .join(stats.alias("s"), "col_no", "left")
        .select(
            F.lit(name).alias("table_name"),
            F.coalesce(whole, F.lit(0)).alias("row_count"),
            F.lit(len(df.columns)).alias("column_count"),
            "i.ordinal",
            "i.name",
            "i.data_type",
            "i.nullable",
            F.coalesce("s.nulls", F.lit(0)).alias("null_count"),
            F.coalesce(share, F.lit(0.0)).alias("null_pct"),
            F.coalesce("s.distinct_count", F.lit(0)).alias("distinct_count"),
            F.coalesce("s.sample_values", F.array().cast("array<string>")).alias("sample_values"),
            F.col("s.min_num").alias("min_num"),
            F.col("s.max_num").alias("max_num"),
            F.col("s.avg_num").alias("avg_num"),
        )
    )


def _basic(df: DataFrame, approx: bool) -> DataFrame:
    """Rows, NULLs, min, max and avg of every column in its own type: one pass of partial aggregates, no
    value is shuffled. With `approx`, distinct counts come from sketches in the same pass."""
    structs = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        number = _family(f.dataType) != "other"
        none = F.lit(None)
        structs.append(
            F.struct(
                F.lit(str(i)).alias("col_no"),
                F.count("*").alias("rows"),
                F.count_if(c.isNull()).alias("nulls"),
                (F.min(c) if number else none).cast("string").alias("min_num"),
                (F.max(c) if number else none).cast("string").alias("max_num"),
                (F.avg(c.cast("double")) if number else none).cast("double").alias("avg_num"),
                *([F.approx_count_distinct(_as_text(f)).alias("distinct_count")] if approx else []),
            )
        )
    return df.agg(F.array(*structs).alias("all")).select(F.inline("all"))


def _exact(df: DataFrame, k: int) -> DataFrame:
    counts = value_counts(df)
    distinct = counts.groupBy("col_no").agg(F.count(F.when(F.col("n") > 0, F.col("value"))).alias("distinct_count"))
    # NULLs sort last and leave after the ranking, and `n` stays in use: so both branches hold the
    # same count plan and AQE reads one exchange twice
    place = F.row_number().over(Window.partitionBy("col_no").orderBy(F.col("value").asc_nulls_last()))
    samples = (
        counts.filter("n > 0")
        .withColumn("place", place)
        .filter((F.col("place") <= k) & F.col("value").isNotNull())
        .groupBy("col_no")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("sample_values"))
    )
    return _basic(df, approx=False).join(distinct, "col_no", "left").join(samples, "col_no", "left")


def _sketched(df: DataFrame, k: int, seed: int) -> DataFrame:
    basic = cut(_basic(df, approx=True))
    distinct = {r["col_no"]: r["distinct_count"] for r in basic.select("col_no", "distinct_count").collect()}
    texts = {str(i): _as_text(f) for i, f in enumerate(df.schema.fields)}
    samples = bottomk.values(df, texts, distinct, k, seed)
    return basic.join(samples.select(F.col("name").alias("col_no"), F.col("sample").alias("sample_values")), "col_no", "left")


def profile_path(
    spark: SparkSession, path: str, fmt: str, schema: T.StructType | str | None = None, read_options: dict[str, str] | None = None, **options
) -> DataFrame:
    """The profile of a csv, json or parquet file or folder, named after it; options are those of `profile`."""
    return profile(files.read(spark, path, fmt, schema, **(read_options or {})), files.table_name(path), **options)


def profile_tables(tables: dict[str, DataFrame], **options) -> DataFrame:
    """Profiles of many tables, one distributed aggregate each."""
    out = None
    for name, df in tables.items():
        one = profile(df, name, **options)
        out = one if out is None else out.unionByName(one)
    return out


def profile_schema(
    spark: SparkSession, schema: str, tables: list[str] | None = None, source_prefix: str = "", **options
) -> tuple[DataFrame, DataFrame]:
    """(tables, columns) of a catalog schema."""
    columns = profile_tables(catalog.scan(spark, schema, tables), **options)
    prefix = source_prefix or schema
    columns = columns.withColumn("record_source", F.concat(F.lit(f"{prefix}."), F.col("table_name")))
    return summary(columns), columns


def summary(columns: DataFrame) -> DataFrame:
    """One row per table: columns, rows, foreign-key links, whether statistics are there."""
    linked = F.col("is_foreign_key") if "is_foreign_key" in columns.columns else F.lit(False)
    return columns.groupBy("table_name").agg(
        F.count("*").alias("column_count"),
        F.max("row_count").alias("row_count"),
        F.count_if(linked).alias("fk_links"),
        F.bool_or(F.col("null_pct").isNotNull()).alias("has_stats"),
    )


def likely_keys(columns: DataFrame) -> DataFrame:
    """likely_pk and likely_fk by column name and nullability."""
    name, table = F.lower("name"), F.lower("table_name")
    ends = name.endswith("_id")
    pk = (name == F.concat(table, F.lit("_id"))) | (ends & ~F.col("nullable"))
    return columns.withColumn("likely_pk", pk).withColumn("likely_fk", ends & ~pk)


def with_fallback(live: DataFrame, inventory: DataFrame) -> DataFrame:
    """Inventory columns with live statistics where there are any, else the inventory's own.

    stats_source names the tier used per column.
    """
    has_live = (F.col("l.row_count") > 0) & F.col("l.null_pct").isNotNull()
    stored = (
        F.col("m.null_pct").isNotNull()
        | F.col("m.distinct_count").isNotNull()
        | (F.coalesce(F.size("m.sample_values"), F.lit(0)) > 0)
    )
    tier = F.when(has_live, LIVE).when(stored, FROM_METADATA).otherwise(NO_STATS)
    note = (
        F.when(has_live, "statistics computed from the table")
        .when(stored, "statistics taken from the inventory")
        .otherwise("no statistics available")
    )
    joined = inventory.alias("m").join(
        live.alias("l"),
        (F.lower("m.table_name") == F.lower("l.table_name")) & (F.lower("m.name") == F.lower("l.name")),
        "left",
    )

    def chosen(column: str) -> Column:
        return F.when(has_live, F.col(f"l.{column}")).otherwise(F.col(f"m.{column}")).alias(column)

    return joined.select(
        "m.table_name",
        chosen("row_count"),
        "m.ordinal",
        "m.name",
        "m.data_type",
        "m.nullable",
        chosen("null_pct"),
        chosen("distinct_count"),
        chosen("sample_values"),
        tier.alias("stats_source"),
        note.alias("stats_note"),
    )


def cap(columns: DataFrame, max_columns: int, max_samples: int) -> DataFrame:
    """The first columns of each table and the first samples of each column."""
    place = F.row_number().over(Window.partitionBy("table_name").orderBy("ordinal"))
    return (
        columns.withColumn("_place", place)
        .filter(F.col("_place") <= max_columns)
        .drop("_place", "raw_data")
        .withColumn("sample_values", F.slice("sample_values", 1, max_samples))
    )
