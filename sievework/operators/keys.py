"""Key and relationship detection over column inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FK_PATTERN = r"^(.+?)_id$"
PK_SUFFIX = "_id"
BUSINESS_KEY_PATTERN = "_(id|code|num|key)$"


def primary_keys(columns: DataFrame, suffix: str = PK_SUFFIX) -> DataFrame:
    """is_primary_key: named after the table, and one distinct value per row."""
    named = F.lower("name") == F.concat(F.lower("table_name"), F.lit(suffix))
    unique = (F.col("row_count") > 0) & (F.col("distinct_count") == F.col("row_count"))
    return columns.withColumn("is_primary_key", F.coalesce(named & unique, F.lit(False)))


def business_key_candidates(columns: DataFrame, pattern: str = BUSINESS_KEY_PATTERN) -> DataFrame:
    return columns.filter(F.lower("name").rlike(pattern))


def resolve(columns: DataFrame, pattern: str = FK_PATTERN, suffix: str = PK_SUFFIX) -> DataFrame:
    """Edges from columns named after another table.

    high: that table is loaded and has the key; medium: loaded without it; low: not loaded.
    Nothing is found when only one table is loaded.
    """
    tables = columns.groupBy(F.lower("table_name").alias("ref")).agg(
        F.min("table_name").alias("loaded_name"),
        F.bool_or(F.lower("name") == F.concat(F.lower("table_name"), F.lit(suffix))).alias("has_key"),
    )
    several = tables.agg((F.count("*") > 1).alias("several")).scalar()
    refs = (
        columns.select(
            F.col("table_name").alias("from_table"),
            F.col("name").alias("from_column"),
            F.regexp_extract(F.lower("name"), pattern, 1).alias("ref"),
        )
        .filter((F.col("ref") != "") & (F.col("ref") != F.lower("from_table")))
        .filter(several)
    )
    own_key = F.concat("ref", F.lit(suffix))
    loaded = F.col("loaded_name").isNotNull()
    return refs.join(tables, "ref", "left").select(
        "from_table",
        "from_column",
        F.coalesce("loaded_name", "ref").alias("to_table"),
        F.when(loaded & ~F.col("has_key"), "?").otherwise(own_key).alias("to_column"),
        F.when(loaded & F.col("has_key"), "high").when(loaded, "medium").otherwise("low").alias("confidence"),
    )


def with_foreign_keys(columns: DataFrame, edges: DataFrame) -> DataFrame:
    """is_foreign_key and fk_references on the column inventory."""
    target = F.when(F.col("confidence") == "low", F.concat("to_table", F.lit(" (not loaded)"))).otherwise(
        F.concat_ws(".", "to_table", "to_column")
    )
    refs = edges.select(
        F.col("from_table").alias("table_name"), F.col("from_column").alias("name"), target.alias("fk_references")
    )
    return columns.drop("is_foreign_key", "fk_references").join(refs, ["table_name", "name"], "left").withColumn(
        "is_foreign_key", F.col("fk_references").isNotNull()
    )


def relationships(tables: DataFrame) -> DataFrame:
    """Flat list of the relationships stored inside table rows."""
    return tables.select(
        F.col("table_name").alias("from_table"), F.explode("relationships").alias("r")
    ).select("from_table", "r.from_column", "r.to_table", "r.to_column", "r.confidence")


def unmatched(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """One row: distinct child keys, and how many of them the parent lacks."""
    keys = child.filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("k")).agg(F.count("*").alias("n"))
    parents = parent.select(F.col(parent_key).alias("k"), F.lit(True).alias("there")).distinct()
    return keys.join(parents, "k", "left").agg(
        F.count("*").alias("child_keys"),
        F.count_if(F.col("there").isNull()).alias("missing_keys"),
        F.coalesce(F.sum(F.when(F.col("there").isNull(), F.col("n"))), F.lit(0)).alias("missing_rows"),
    )


def _comparable(field: T.StructField) -> tuple[str, Column] | None:
    """The family of types whose values may equal each other, and the value in its form; None for nested types."""
    c, t = F.col(f"`{field.name}`"), field.dataType
    if isinstance(t, T.IntegralType):
        return "whole", c.cast("bigint")
    if isinstance(t, T.DecimalType):
        return "decimal", c.cast("decimal(38,10)").cast("string")
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "fraction", c.cast("double") + F.lit(0.0)
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time", c.cast("timestamp_ntz").cast("string")
    if isinstance(t, (T.StringType, T.BooleanType, T.BinaryType)):
        return t.typeName(), c
    return None


WORD = 63


def inclusions(tables: dict[str, DataFrame]) -> DataFrame:
    """All pairs of columns of which one holds every value of the other: from_table, from_column, to_table, to_column, n_values.

    One inverted pass instead of a join per pair. Each value, as 128 bits salted with its type family, is
    brought together with the columns that hold it, as a bitmap of columns; a task combines what it reads
    before the only shuffle of values, so a value that fills a third of the rows counts once a task. Equal
    bitmaps are counted together. A column is included in those columns whose bit is in every bitmap with
    its own: one more aggregate, over distinct bitmaps. NULL is no value; columns without values are in
    no pair; nested columns are left out.
    """
    columns = [(name, f.name, kind) for name, df in tables.items() for f in df.schema.fields if (kind := _comparable(f))]
    if not columns:
        raise ValueError("no column to compare")
    spark = next(iter(tables.values())).sparkSession
    words = -(-len(columns) // WORD)
    names = [f"w{w}" for w in range(words)]
    held = None
    for name, df in tables.items():
        own = [(i, value, family) for i, (t, _, (family, value)) in enumerate(columns) if t == name]
        if not own:
            continue
        marks = [
            F.struct(
                F.when(v.isNotNull(), F.xxhash64(F.lit(family), v)).alias("first"), F.xxhash64(F.lit(1), F.lit(family), v).alias("second"),
                *[F.lit(1 << i % WORD if i // WORD == w else 0).cast("long").alias(n) for w, n in enumerate(names)],
            )
            for i, v, family in own
        ]
        one = df.select(F.inline(F.array(*marks))).where("first IS NOT NULL")
        held = one if held is None else held.unionByName(one)
    bitmaps = held.groupBy("first", "second").agg(*[F.bit_or(n).alias(n) for n in names]).groupBy(*names).agg(F.count("*").alias("n"))

    def bits(word: str, w: int) -> Column:
        """Numbers of the columns whose bit is set."""
        here = F.array(*[F.lit(i) for i in range(w * WORD, min((w + 1) * WORD, len(columns)))])
        return F.filter(here, lambda i: F.getbit(F.col(word), i - w * WORD) == 1)

    members = F.concat(*[bits(n, w) for w, n in enumerate(names)])
    inside = bitmaps.select(F.explode(members).alias("own"), *names, "n").groupBy("own").agg(
        F.sum("n").alias("n_values"), *[F.bit_and(n).alias(n) for n in names]
    )
    pairs = inside.select("own", "n_values", F.explode(members).alias("other")).where("own <> other")
    called = spark.createDataFrame([(i, t, c) for i, (t, c, _) in enumerate(columns)], "no int, t string, c string")
    side = lambda n, to: called.select(F.col("no").alias(n), F.col("t").alias(f"{to}_table"), F.col("c").alias(f"{to}_column"))
    return pairs.join(side("own", "from"), "own").join(side("other", "to"), "other").select("from_table", "from_column", "to_table", "to_column", "n_values")
