"""Flatten stored run results: JSON documents in, one row per item out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULE = (
    "STRUCT<rule_id: STRING, rule_type: STRING, priority: STRING, column: STRING, description: STRING, "
    "threshold: STRING, sql: STRING, pass_condition: STRING, fail_action: STRING>"
)
RULE_TABLE = f"STRUCT<table_name: STRING, fully_qualified_name: STRING, dq_rules: ARRAY<{RULE}>>"
RULES = (
    f"table_name STRING, fully_qualified_name STRING, dq_rules ARRAY<{RULE}>, tables ARRAY<{RULE_TABLE}>"
)
QUERIES = (
    "queries ARRAY<STRUCT<rule_id: STRING, rule_type: STRING, column: STRING, priority: STRING, sql: STRING, "
    "pass_condition: STRING, monitoring_label: STRING>>"
)
TEST_CASES = (
    "test_cases ARRAY<STRUCT<test_id: STRING, category: STRING, priority: STRING, description: STRING, "
    "input_condition: STRING, expected_result: STRING, validation_sql: STRING>>"
)
TEST_QUERIES = (
    "queries ARRAY<STRUCT<query_id: STRING, test_description: STRING, priority: STRING, sql: STRING, "
    "pass_condition: STRING, expected_zero_means: STRING>>"
)
MODEL = (
    "entities ARRAY<STRUCT<entity_type: STRING, table_name: STRING, load_strategy: STRING, columns: "
    "ARRAY<STRUCT<name: STRING, data_type: STRING, nullable: BOOLEAN, description: STRING>>>>"
)
_STTM_BODY = (
    "source_table{c} STRING, target_table{c} STRING, column_mappings{c} ARRAY<STRUCT<source_column: STRING, "
    "source_data_type: STRING, target_column: STRING, target_data_type: STRING, transformation_rule: STRING, "
    "nullable: BOOLEAN, notes: STRING>>"
)
STTM = f"{_STTM_BODY.format(c='')}, sttm STRUCT<{_STTM_BODY.format(c=':')}>"
LINEAGE = (
    "lineage_graph STRUCT<nodes: ARRAY<STRUCT<id: STRING, label: STRING, type: STRING, layer: STRING, "
    "description: STRING>>, edges: ARRAY<STRUCT<`from`: STRING, `to`: STRING, transformation: STRING, "
    "load_type: STRING>>>"
)
PROFILES = (
    "profiles ARRAY<STRUCT<table_name: STRING, columns: ARRAY<STRUCT<name: STRING, data_type: STRING, "
    "nullable: BOOLEAN, null_pct: DOUBLE, distinct_count: BIGINT, sample_values: ARRAY<STRING>, "
    "likely_pk: BOOLEAN, likely_fk: BOOLEAN, stats_source: STRING>>>>"
)
SAMPLES = "samples ARRAY<STRUCT<table_name: STRING, rows: ARRAY<MAP<STRING, STRING>>>>"
CONFIGS = (
    "ingestion_configs ARRAY<STRUCT<source_table: STRING, target_table: STRING, source_format: STRING, "
    "load_type: STRING, checkpoint_location: STRING, schema_location: STRING, selected_columns: ARRAY<STRING>>>"
)


def unfenced(text: Column) -> Column:
    """Text without its Markdown code fence."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(
        bare.startswith("```"), F.regexp_replace(F.regexp_replace(bare, r"^```[^\n]*\n", ""), r"\n?```\s*$", "")
    ).otherwise(bare)


def parsed(results: DataFrame, schema: str, text: str = "output") -> DataFrame:
    """Documents that parse, as column `doc`; a list gives a row for each of its items."""
    body = unfenced(F.col(text))
    each = F.when(body.startswith("["), F.from_json(body, "ARRAY<STRING>")).otherwise(F.array(body))
    items = results.withColumn("doc", F.explode(each))
    return items.withColumn("doc", F.from_json("doc", schema)).filter(F.col("doc").isNotNull())


def _is_readable(text: Column) -> Column:
    body = unfenced(text)
    return F.from_json(body, "MAP<STRING, STRING>").isNotNull() | F.from_json(body, "ARRAY<STRING>").isNotNull()


def unreadable(results: DataFrame, text: str = "output") -> DataFrame:
    """Results whose output is no JSON object or list."""
    return results.filter(~_is_readable(F.col(text)))


def _items(results: DataFrame, schema: str, path: str, keep: list[str]) -> DataFrame:
    rows = parsed(results, schema).select(*keep, F.explode(f"doc.{path}").alias("item"))
    return rows.select(*keep, "item.*")


def rules(results: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per rule, from the single-table or the many-table form."""
    keep = keep or []
    own = F.array(
        F.struct(
            F.col("doc.table_name").alias("table_name"),
            F.col("doc.fully_qualified_name").alias("fully_qualified_name"),
            F.col("doc.dq_rules").alias("dq_rules"),
        )
    )
    tables = parsed(results, RULES).select(*keep, F.explode(F.coalesce("doc.tables", own)).alias("t"))
    return tables.select(*keep, "t.table_name", "t.fully_qualified_name", F.explode("t.dq_rules").alias("r")).select(
        *keep, "table_name", "fully_qualified_name", "r.*"
    )


def queries(results: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return _items(results, QUERIES, "queries", keep or [])


def test_cases(results: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return _items(results, TEST_CASES, "test_cases", keep or [])


def test_queries(results: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return _items(results, TEST_QUERIES, "queries", keep or [])


def model_columns(results: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per entity column."""
    keep = keep or []
    entities = _items(results, MODEL, "entities", keep)
    return entities.select(
        *keep, "entity_type", "table_name", "load_strategy", F.explode("columns").alias("c")
    ).select(
        *keep, "entity_type", "table_name", "load_strategy", F.col("c.name").alias("column_name"),
        "c.data_type", "c.nullable", "c.description",
    )


def mapping_rows(results: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Mapping rows with their source and target table."""
    keep = keep or []
    docs = parsed(results, STTM).select(
        *keep,
        F.coalesce("doc.sttm.source_table", "doc.source_table").alias("source_table"),
        F.coalesce("doc.sttm.target_table", "doc.target_table").alias("target_table"),
        F.explode(F.coalesce("doc.sttm.column_mappings", "doc.column_mappings")).alias("m"),
    )
    return docs.select(*keep, "source_table", "target_table", "m.*")


def lineage_edges(results: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return _items(results, LINEAGE, "lineage_graph.edges", keep or [])


def lineage_nodes(results: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per node of every graph, whether it has edges or not."""
    rows = parsed(results, LINEAGE)
    keep = keep or []
    return rows.select(*keep, F.explode("doc.lineage_graph.nodes").alias("n")).select(*keep, "n.*")


def profile_columns(results: DataFrame, keep: list[str] | None = None) -> DataFrame:
    keep = keep or []
    tables = _items(results, PROFILES, "profiles", keep)
    return tables.select(*keep, "table_name", F.explode("columns").alias("c")).select(*keep, "table_name", "c.*")


def sample_rows(results: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per sample row; values as a map, since each table has its own columns."""
    keep = keep or []
    tables = _items(results, SAMPLES, "samples", keep)
    return tables.select(*keep, "table_name", F.explode("rows").alias("row"))


def ingestion_configs(results: DataFrame, keep: list[str] | None = None) -> DataFrame:
    rows = _items(results, CONFIGS, "ingestion_configs", keep or [])
    return rows.withColumn("columns", F.array_join("selected_columns", ", ")).drop("selected_columns")


def by_priority(rule_rows: DataFrame) -> DataFrame:
    return rule_rows.groupBy("priority").agg(F.count("*").alias("rules"))
