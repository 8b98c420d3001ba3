"""Recommend quality rules from column profiles and detected keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Column names and patterns the rule texts name.
FRESHNESS_COLUMNS = ["load_date", "created_at", "updated_at", "event_time"]
PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$",
    "phone": r"^\+?[0-9 ()\-]{7,20}$",
    "postal_code": r"^[A-Za-z0-9][A-Za-z0-9 \-]{2,9}$",
    "country_code": r"^[A-Z]{2,3}$",
}
PRIORITIES = {
    "NOT_NULL": "P1", "UNIQUE": "P1", "ROW_COUNT": "P1", "REFERENTIAL": "P1",
    "FRESHNESS": "P2", "COMPLETENESS": "P2",
    "RANGE_CHECK": "P3",
    "REGEX_PATTERN": "P4", "LENGTH_CHECK": "P4", "ENUM_CHECK": "P4",
}
FAIL_ACTIONS = {"P1": "block", "P2": "alert", "P3": "alert", "P4": "log"}
COMPLETENESS_LOW, COMPLETENESS_HIGH = 0.01, 0.20
NUMBER_TYPES = r"^(tinyint|smallint|int|bigint|float|double|decimal)"


def _no_params() -> Column:
    return F.create_map().cast("map<string,string>")


def _params(**items: Column) -> Column:
    pairs = [p for k, v in items.items() for p in (F.lit(k), v.cast("string"))]
    return F.create_map(*pairs)


def _rule(kind: str, params: Column, priorities: dict[str, str], column: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("rule_type"),
        (F.col("name") if column is None else column).alias("column_name"),
        F.lit(priorities[kind]).alias("priority"),
        params.alias("params"),
    )


def recommend(
    columns: DataFrame,
    edges: DataFrame | None = None,
    priorities: dict[str, str] | None = None,
    wanted: list[str] | None = None,
    max_rules: int | None = None,
    *,
    enum_limit: int,
) -> DataFrame:
    """Rule rows for profiled columns.

    columns: a profile with is_primary_key, is_foreign_key and is_business_key flags, and with all
    values of low-cardinality columns in sample_values (profile with k=enum_limit).
    enum_limit: text columns with fewer values than this get an ENUM_CHECK; the caller's definition.
    max_rules: keep that many rules per table, by priority; None keeps all.
    edges: resolved relationships; those of high confidence become REFERENTIAL rules.
    """
    ranks = {**PRIORITIES, **(priorities or {})}
    key = F.col("is_primary_key") | F.col("is_foreign_key")
    needs_value = ~F.col("nullable") | key
    owned = (F.col("is_primary_key") | F.col("is_business_key")) & ~F.col("is_foreign_key")
    name = F.lower("name")
    numeric = F.col("data_type").rlike(NUMBER_TYPES)
    pattern = F.element_at(F.create_map(*[F.lit(x) for kv in PATTERNS.items() for x in kv]), name)
    gap = F.col("null_pct").between(COMPLETENESS_LOW, COMPLETENESS_HIGH)
    few = (F.col("data_type") == "string") & F.col("distinct_count").between(1, enum_limit - 1)

    candidates = F.array(
        F.when(needs_value, _rule("NOT_NULL", _no_params(), ranks)),
        F.when(owned, _rule("UNIQUE", _no_params(), ranks)),
        F.when(name.isin(FRESHNESS_COLUMNS), _rule("FRESHNESS", _params(hours=F.lit("25")), ranks)),
        F.when(gap & ~needs_value, _rule("COMPLETENESS", _no_params(), ranks)),
        F.when(
            numeric & ~key & F.col("min_num").isNotNull(),
            _rule("RANGE_CHECK", _params(min=F.col("min_num"), max=F.col("max_num")), ranks),
        ),
        F.when(name.isin(*PATTERNS), _rule("REGEX_PATTERN", _params(pattern=pattern), ranks)),
        F.when(few, _rule("ENUM_CHECK", _params(values=F.to_json("sample_values")), ranks)),
    )
    per_column = columns.select("table_name", F.explode(F.array_compact(candidates)).alias("r"))
    per_table = columns.select("table_name").distinct().select(
        "table_name",
        _rule("ROW_COUNT", _params(min=F.lit("0")), ranks, F.lit(None).cast("string")).alias("r"),
    )
    rules = per_column.unionByName(per_table)
    if edges is not None:
        joined = edges.filter(F.col("confidence") == "high").select(
            F.col("from_table").alias("table_name"),
            _rule(
                "REFERENTIAL",
                _params(parent=F.col("to_table"), parent_column=F.col("to_column")),
                ranks,
                F.col("from_column"),
            ).alias("r"),
        )
        rules = rules.unionByName(joined)
    rules = rules.select("table_name", "r.*").dropDuplicates(["table_name", "rule_type", "column_name"])
    if wanted is not None:
        rules = rules.filter(F.col("priority").isin(wanted))

    place = F.row_number().over(
        Window.partitionBy("table_name").orderBy("priority", "rule_type", "column_name")
    )
    actions = F.create_map(*[F.lit(x) for kv in FAIL_ACTIONS.items() for x in kv])
    text = F.concat_ws("_", "rule_type", "column_name")
    placed = rules.withColumn("place", place)
    return (
        (placed if max_rules is None else placed.filter(F.col("place") <= max_rules))
        .select(
            "table_name",
            F.format_string("DQ_%03d", F.col("place")).alias("rule_id"),
            "rule_type",
            "column_name",
            "priority",
            "params",
            F.element_at(actions, F.col("priority")).alias("fail_action"),
            text.alias("monitoring_label"),
        )
    )


def sql_text(rules: DataFrame, schema: str = "") -> DataFrame:
    """The rule as one runnable statement that returns its failure count."""
    prefix = f"`{schema}`." if schema else ""
    table = F.concat(F.lit(prefix), F.lit("`"), F.col("table_name"), F.lit("`"))
    column = F.concat(F.lit("`"), F.col("column_name"), F.lit("`"))

    def quoted(c: Column) -> Column:
        return F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))

    def param(k: str) -> Column:
        return F.element_at("params", k)

    values = F.array_join(F.transform(F.from_json(param("values"), "ARRAY<STRING>"), quoted), ", ")

    def where(condition: Column) -> Column:
        return F.concat(F.lit("SELECT COUNT(*) FROM "), table, F.lit(" WHERE "), condition)

    kind = F.col("rule_type")
    parent = F.concat(F.lit(prefix), F.lit("`"), param("parent"), F.lit("`"))
    statement = (
        F.when(kind.isin("NOT_NULL", "COMPLETENESS"), where(F.concat(column, F.lit(" IS NULL"))))
        .when(kind == "UNIQUE", F.concat(F.lit("SELECT COUNT(*) - COUNT(DISTINCT "), column, F.lit(") FROM "), table))
        .when(
            kind == "ROW_COUNT",
            F.concat(F.lit("SELECT CASE WHEN COUNT(*) <= "), param("min"), F.lit(" THEN 1 ELSE 0 END FROM "), table),
        )
        .when(
            kind == "FRESHNESS",
            F.concat(
                F.lit("SELECT CASE WHEN MAX("), column, F.lit(") < CURRENT_TIMESTAMP - INTERVAL "), param("hours"),
                F.lit(" HOURS THEN 1 ELSE 0 END FROM "), table,
            ),
        )
        .when(
            kind == "RANGE_CHECK",
            where(F.concat(column, F.lit(" < "), param("min"), F.lit(" OR "), column, F.lit(" > "), param("max"))),
        )
        .when(kind == "REGEX_PATTERN", where(F.concat(column, F.lit(" NOT RLIKE "), quoted(param("pattern")))))
        .when(kind == "ENUM_CHECK", where(F.concat(column, F.lit(" NOT IN ("), values, F.lit(")"))))
        .when(
            kind == "REFERENTIAL",
            F.concat(
                F.lit("SELECT COUNT(*) FROM "), table, F.lit(" c LEFT JOIN "), parent, F.lit(" p ON c."), column,
                F.lit(" = p.`"), param("parent_column"), F.lit("` WHERE p.`"), param("parent_column"),
                F.lit("` IS NULL"),
            ),
        )
    )
    return rules.withColumn("sql", statement)
