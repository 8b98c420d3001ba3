"""Run a suite of quality rules: all rules of a table that need no join share one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.operators import checks
from sievework.operators.checks import Rule


class QualityGateError(Exception):
    """A blocking rule failed."""


def label(rule: Rule) -> str:
    return "_".join([rule.rule_type, *rule.columns])


def labels(rules: list[Rule]) -> list[str]:
    """A label for each rule of a suite: type and columns; rules that share these are told apart by their id, or else by their place."""
    plain = [label(r) for r in rules]
    named = [f"{text}_{r.rule_id}" if plain.count(text) > 1 and r.rule_id else text for text, r in zip(plain, rules)]
    return [f"{text}_{named[: i + 1].count(text)}" if named.count(text) > 1 else text for i, text in enumerate(named)]


def _result(rule: Rule, text: str, failures: Column) -> Column:
    failures = failures.cast("bigint")
    return F.struct(
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.table).alias("table_name"),
        F.lit(rule.rule_type).alias("rule_type"),
        F.lit(rule.column).cast("string").alias("column_name"),
        F.lit(rule.priority).alias("priority"),
        F.lit(rule.fail_action).alias("fail_action"),
        F.lit(text).alias("monitoring_label"),
        failures.alias("failures"),
        (failures == 0).alias("passed"),
    )


def run(tables: dict[str, DataFrame], rules: list[Rule], as_of: str) -> DataFrame:
    """One result row per rule."""
    unknown = {r.rule_type for r in rules} - set(checks.RULE_TYPES)
    if unknown:
        raise ValueError(f"unknown rule types {sorted(unknown)}")
    scanned: dict[str, list[tuple[Rule, str]]] = {}
    parts = []
    for rule, text in zip(rules, labels(rules)):
        if rule.rule_type in checks.JOINED_RULES:
            one = checks.JOINED_RULES[rule.rule_type](rule, tables)
            parts.append(one.select(F.inline(F.array(_result(rule, text, F.col("failures"))))))
        else:
            scanned.setdefault(rule.table, []).append((rule, text))
    for table, mine in scanned.items():
        df = tables[table]
        counts = df.agg(*[checks.aggregate(r, df, as_of).alias(f"f{i}") for i, (r, _) in enumerate(mine)])
        results = [_result(r, text, F.col(f"f{i}")) for i, (r, text) in enumerate(mine)]
        parts.append(counts.select(F.inline(F.array(*results))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def null_cover(table: str, df: DataFrame, priority: str = "P2") -> list[Rule]:
    """One NULL test per nullable column."""
    return [Rule(table, "COMPLETENESS", f.name, priority) for f in df.schema if f.nullable]


def boundary_cover(table: str, df: DataFrame, priority: str = "P3") -> list[Rule]:
    """Empty table, all-NULL columns, numbers at their type's maximum."""
    rules = [Rule(table, "EMPTY_SOURCE", None, priority)]
    rules += [Rule(table, "ALL_NULL", f.name, priority) for f in df.schema]
    whole = [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)]
    return rules + [Rule(table, "NUMERIC_MAX", name, priority) for name in whole]


def by_priority(results: DataFrame) -> DataFrame:
    return results.orderBy("priority", "table_name", "rule_id")


def priority_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("priority").agg(
        F.count("*").alias("rules"), F.count_if(~F.col("passed")).alias("failed")
    )


def enforce(results: DataFrame) -> None:
    """Raise if a blocking rule failed. Call it after the results are written."""
    blocked = results.filter((F.col("fail_action") == "block") & ~F.col("passed"))
    labels = [r[0] for r in blocked.select("monitoring_label").orderBy("monitoring_label").collect()]
    if labels:
        raise QualityGateError(f"blocking rules failed: {', '.join(labels)}")


def quarantine(df: DataFrame, rules: list[Rule], as_of: str | None = None) -> DataFrame:
    """Mark each row with the labels of the row rules it breaks; an empty list means good."""
    broken = [F.when(checks.bad_row(r, df, as_of), F.lit(text)) for r, text in zip(rules, labels(rules)) if r.rule_type in checks.ROW_RULES]
    return df.withColumn("broken_rules", F.array_compact(F.array(*broken)))


def with_ids(rules: DataFrame, prefix: str = "DQ", per: tuple[str, ...] = ("table_name",)) -> DataFrame:
    """DQ_001, DQ_002, ... by priority within each table."""
    place = F.row_number().over(Window.partitionBy(*per).orderBy("priority", "rule_type", "column_name"))
    return rules.withColumn("rule_id", F.format_string(f"{prefix}_%03d", place))


def attach(rules_json: DataFrame, tables: DataFrame) -> DataFrame:
    """Every table with its stored rule documents, parsed; tables without rules drop out."""
    schema = (
        "ARRAY<STRUCT<rule_type: STRING, column: STRING, priority: STRING, "
        "params: MAP<STRING, STRING>, fail_action: STRING>>"
    )
    rules = rules_json.select("table_name", F.explode(F.from_json("rules", schema)).alias("r"))
    return tables.select("table_name").distinct().join(rules, "table_name").select(
        "table_name", F.col("r.rule_type").alias("rule_type"), F.col("r.column").alias("column_name"),
        "r.priority", "r.params", "r.fail_action",
    )


def to_rules(rules: DataFrame) -> list[Rule]:
    """Rule rows as plan input. The rule table is as small as the schema it describes."""
    return [
        Rule(
            table=r["table_name"],
            rule_type=r["rule_type"],
            column=r["column_name"],
            priority=r["priority"],
            params=dict(r["params"] or {}),
            rule_id=r["rule_id"],
            fail_action=r["fail_action"],
        )
        for r in rules.select(
            "table_name", "rule_type", "column_name", "priority", "params", "rule_id", "fail_action"
        ).collect()
    ]

