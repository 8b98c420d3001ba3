"""Quality checks, suites, recommendations, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.operators import checks, digests, keys, mapping, profile, recon, vault
from sievework.operators.checks import Rule
from sievework.plans import recommend, suite
from sievework.registered.profiling import GAPPY_ORDERS, gappy_orders
from sievework.registered.registry import query, scratch_schema, table, tables
from sievework.session import cut, scratch
from sievework.sources import sinks

AS_OF = "2024-01-31 00:00:00"


def rows_of(results: DataFrame) -> DataFrame:
    return results.select("table_name", "rule_type", "column_name", "failures", "passed")


def row_sql(rule: Rule, failures: str) -> str:
    column = f"'{rule.column}'" if rule.column else "CAST(NULL AS VARCHAR)"
    return (
        f"SELECT '{rule.table}' AS table_name, '{rule.rule_type}' AS rule_type, {column} AS column_name, "
        f"CAST(f AS BIGINT) AS failures, f = 0 AS passed FROM ({failures}) AS t(f)"
    )


def check(key: str, *pairs: tuple[Rule, str], prepare=None) -> None:
    """Register a query that runs the rules, with one failure-count statement each as its SQL."""
    rules = [r for r, _ in pairs]
    names = sorted({n for r in rules for n in (r.table, r.params.get("parent")) if n})

    def run(spark, sf_dir):
        t = prepare(spark, sf_dir) if prepare else tables(spark, sf_dir, *names)
        return rows_of(suite.run(t, rules, AS_OF))

    query(key, " UNION ALL ".join(row_sql(r, sql) for r, sql in pairs))(run)


def _gappy(spark, sf_dir):
    return {"orders": gappy_orders(spark, sf_dir)}


check(
    "dq_not_null",
    (Rule("orders", "NOT_NULL", "o_orderpriority"), f"SELECT count(*) FROM {GAPPY_ORDERS} WHERE o_orderpriority IS NULL"),
    (Rule("orders", "NOT_NULL", "o_orderkey"), "SELECT count(*) FROM orders WHERE o_orderkey IS NULL"),
    prepare=_gappy,
)
check(
    "dq_completeness",
    (Rule("orders", "COMPLETENESS", "o_orderpriority"), f"SELECT count(*) FROM {GAPPY_ORDERS} WHERE o_orderpriority IS NULL"),
    (
        Rule("orders", "COMPLETENESS_RATIO", "o_orderpriority", params={"threshold": "0.95"}),
        f"SELECT CASE WHEN count(o_orderpriority) / count(*) < 0.95 THEN 1 ELSE 0 END FROM {GAPPY_ORDERS}",
    ),
    (
        Rule("orders", "COMPLETENESS_RATIO", "o_orderpriority", params={"threshold": "0.5"}),
        f"SELECT CASE WHEN count(o_orderpriority) / count(*) < 0.5 THEN 1 ELSE 0 END FROM {GAPPY_ORDERS}",
    ),
    prepare=_gappy,
)
check(
    "dq_unique",
    (Rule("orders", "UNIQUE", "o_orderkey"), "SELECT count(*) - count(DISTINCT o_orderkey) FROM orders"),
    (Rule("orders", "UNIQUE", "o_orderpriority"), f"SELECT count(*) - count(DISTINCT o_orderpriority) FROM {GAPPY_ORDERS}"),
    prepare=_gappy,
)
check(
    "dq_unique_composite",
    (
        Rule("lineitem", "UNIQUE", "l_orderkey,l_linenumber"),
        "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) FROM lineitem",
    ),
)
check(
    "dq_range",
    (
        Rule("lineitem", "RANGE_CHECK", "l_discount", params={"min": "0.01", "max": "0.05"}),
        "SELECT count(*) FROM lineitem WHERE l_discount < 0.01 OR l_discount > 0.05",
    ),
    (
        Rule("lineitem", "RANGE_CHECK", "l_quantity", params={"min": "1", "max": "50"}),
        "SELECT count(*) FROM lineitem WHERE l_quantity < 1 OR l_quantity > 50",
    ),
)
check(
    "dq_length",
    (
        Rule("customer", "LENGTH_CHECK", "c_mktsegment", params={"min": "9", "max": "10"}),
        "SELECT count(*) FROM customer WHERE length(c_mktsegment) < 9 OR length(c_mktsegment) > 10",
    ),
    (
        Rule("documents", "LENGTH_CHECK", "text", params={"min": "200"}),
        "SELECT count(*) FROM documents WHERE length(text) < 200",
    ),
)
EMAIL = r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
check(
    "dq_regex",
    (
        Rule("documents", "REGEX_PATTERN", "text", params={"pattern": EMAIL}),
        f"SELECT count(*) FROM documents WHERE NOT regexp_matches(text, '{EMAIL}')",
    ),
    (
        Rule("customer", "REGEX_PATTERN", "c_name", params={"pattern": "^Customer#[0-9]{9}$"}),
        "SELECT count(*) FROM customer WHERE NOT regexp_matches(c_name, '^Customer#[0-9]{9}$')",
    ),
)
check(
    "dq_like",
    (
        Rule("documents", "LIKE_PATTERN", "text", params={"pattern": "%@%.%"}),
        "SELECT count(*) FROM documents WHERE text NOT LIKE '%@%.%'",
    ),
)
check(
    "dq_date_format",
    (
        Rule("orders", "DATE_FORMAT", "day", params={"format": "yyyy-MM-dd"}),
        "SELECT count(*) FROM orders WHERE o_orderpriority = '5-LOW'",
    ),
    prepare=lambda spark, sf_dir: {
        "orders": table(spark, sf_dir, "orders").withColumn(
            "day",
            F.when(F.col("o_orderpriority") == "5-LOW", F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(
                F.date_format("o_orderdate", "yyyy-MM-dd")
            ),
        )
    },
)
check(
    "dq_enum",
    (
        Rule("orders", "ENUM_CHECK", "o_orderstatus", params={"values": '["F", "O"]'}),
        "SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')",
    ),
    (
        Rule("orders", "ENUM_CHECK", "o_orderpriority", params={"values": '["1-URGENT", "2-HIGH", "3-MEDIUM"]'}),
        f"SELECT count(*) FROM {GAPPY_ORDERS} WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')",
    ),
    prepare=_gappy,
)
check(
    "dq_referential",
    (
        Rule("documents", "REFERENTIAL", "doc_id", params={"parent": "labels"}),
        "SELECT count(*) FROM documents c LEFT JOIN labels p ON c.doc_id = p.doc_id WHERE p.doc_id IS NULL",
    ),
    (
        Rule("orders", "REFERENTIAL", "o_custkey", params={"parent": "customer", "parent_column": "c_custkey"}),
        "SELECT count(*) FROM orders c LEFT JOIN customer p ON c.o_custkey = p.c_custkey WHERE p.c_custkey IS NULL",
    ),
)
check(
    "dq_lookup",
    (
        Rule("customer", "LOOKUP", "c_nationkey", params={"parent": "nation", "parent_column": "n_nationkey"}),
        "SELECT count(*) FROM (SELECT nullif(c_nationkey, 3) + CASE WHEN c_nationkey = 5 THEN 100 ELSE 0 END AS k FROM customer) "
        "WHERE k NOT IN (SELECT n_nationkey FROM nation)",
    ),
    prepare=lambda spark, sf_dir: {
        "customer": table(spark, sf_dir, "customer").withColumn(
            "c_nationkey",
            F.nullif("c_nationkey", F.lit(3)) + F.when(F.col("c_nationkey") == 5, 100).otherwise(0),
        ),
        "nation": table(spark, sf_dir, "nation"),
    },
)
check(
    "dq_row_count",
    (Rule("nation", "ROW_COUNT", params={"min": "25"}), "SELECT CASE WHEN count(*) <= 25 THEN 1 ELSE 0 END FROM nation"),
    (Rule("orders", "ROW_COUNT"), "SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM orders"),
    (Rule("orders", "EMPTY_SOURCE"), "SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM orders"),
)
check(
    "dq_duplicate_rows",
    (
        Rule("documents", "DUPLICATE_ROWS", "text,lang"),
        "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) FROM documents",
    ),
    (
        Rule("lineitem", "DUPLICATE_ROWS"),
        "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) FROM lineitem",
    ),
)
check(
    "dq_duplicate_business_key",
    (
        Rule("lineitem", "DUPLICATE_BUSINESS_KEY", "l_orderkey,l_linenumber"),
        "SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
    ),
)
check(
    "dq_freshness",
    (
        Rule("events", "FRESHNESS", "ts"),
        f"SELECT CASE WHEN max(ts) < TIMESTAMP '{AS_OF}' - INTERVAL 25 HOURS THEN 1 ELSE 0 END FROM events",
    ),
    (
        Rule("orders", "FRESHNESS", "o_orderdate", params={"hours": "48"}),
        f"SELECT CASE WHEN max(o_orderdate) < TIMESTAMP '{AS_OF}' - INTERVAL 48 HOURS THEN 1 ELSE 0 END FROM orders",
    ),
)
VARIANCE = (
    "SELECT count(*) FROM (SELECT n, lag(n) OVER (ORDER BY d) AS p FROM (SELECT {day} AS d, count(*) AS n FROM {t} "
    "GROUP BY 1)) WHERE abs(n - p) / p > {limit}"
)
check(
    "dq_variance",
    (
        Rule("events", "RECORD_COUNT_VARIANCE", "day", params={"percent": "5"}),
        VARIANCE.format(day="date_trunc('day', ts)", t="events", limit="0.05"),
    ),
    (
        Rule("orders", "RECORD_COUNT_VARIANCE", "o_orderdate", params={"percent": "50"}),
        VARIANCE.format(day="o_orderdate", t="orders", limit="0.5"),
    ),
    prepare=lambda spark, sf_dir: {
        "events": table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts")),
        "orders": table(spark, sf_dir, "orders"),
    },
)
check(
    "dq_future",
    (Rule("events", "FUTURE_TIMESTAMP", "ts"), f"SELECT count(*) FROM events WHERE ts > TIMESTAMP '{AS_OF}'"),
    (
        Rule("lineitem", "FUTURE_TIMESTAMP", "l_shipdate"),
        f"SELECT count(*) FROM lineitem WHERE l_shipdate + INTERVAL 9000 DAYS > TIMESTAMP '{AS_OF}'",
    ),
    prepare=lambda spark, sf_dir: {
        "events": table(spark, sf_dir, "events"),
        "lineitem": table(spark, sf_dir, "lineitem").withColumn(
            "l_shipdate", F.expr("l_shipdate + INTERVAL '9000' DAY")
        ),
    },
)
check(
    "dq_record_source",
    (
        Rule("documents", "RECORD_SOURCE", "source"),
        "SELECT count(*) FROM documents WHERE lang IN (SELECT min(lang) FROM documents)",
    ),
    prepare=lambda spark, sf_dir: {
        "documents": _blank_first_language(table(spark, sf_dir, "documents")),
    },
)


def _blank_first_language(docs: DataFrame) -> DataFrame:
    first = docs.agg(F.min("lang").alias("lang")).scalar()
    return docs.withColumn("source", F.when(F.col("lang") != first, F.col("source")).otherwise(F.lit("  ")))


check(
    "dq_all_null",
    (Rule("orders", "ALL_NULL", "nothing"), "SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM orders"),
    (Rule("orders", "ALL_NULL", "o_orderstatus"), "SELECT CASE WHEN count(*) > 0 AND count(o_orderstatus) = 0 THEN 1 ELSE 0 END FROM orders"),
    prepare=lambda spark, sf_dir: {
        "orders": table(spark, sf_dir, "orders").withColumn("nothing", F.lit(None).cast("string"))
    },
)
check(
    "dq_special_chars",
    (
        Rule("documents", "SPECIAL_CHARACTERS", "text"),
        r"SELECT count(*) FROM documents WHERE regexp_matches(text, '[^\t\n\r\x20-\x7E]')",
    ),
)
check(
    "dq_numeric_max",
    (
        Rule("part", "NUMERIC_MAX", "p_size"),
        "SELECT count(*) FROM part WHERE p_size = 50",
    ),
    (Rule("part", "NUMERIC_MAX", "p_partkey"), "SELECT count(*) FROM part WHERE p_partkey = 9223372036854775807"),
    prepare=lambda spark, sf_dir: {
        "part": table(spark, sf_dir, "part").withColumn(
            "p_size", F.when(F.col("p_size") == 50, F.lit(2147483647)).otherwise(F.col("p_size")).cast("int")
        )
    },
)


@query(
    "dq_duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def dq_duplicate_keys(spark, sf_dir):
    return checks.excess_copies(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "dq_load_variance",
    """
    SELECT CAST(d AS VARCHAR) AS day, n, p AS previous, round(abs(n - p) / p, 4) AS change
    FROM (SELECT d, n, lag(n) OVER (ORDER BY d) AS p FROM (SELECT o_orderdate AS d, count(*) AS n FROM orders GROUP BY 1))
    """,
)
def dq_load_variance(spark, sf_dir):
    out = checks.load_variance(table(spark, sf_dir, "orders"), "o_orderdate")
    return out.select(F.col("load").cast("string").alias("day"), "n", "previous", F.round("change", 4).alias("change"))


SUITE: list[tuple[Rule, str]] = [
    (Rule("orders", "NOT_NULL", "o_orderkey", "P1", rule_id="DQ_001", fail_action="block"), "SELECT count(*) FROM orders WHERE o_orderkey IS NULL"),
    (Rule("orders", "UNIQUE", "o_orderkey", "P1", rule_id="DQ_002", fail_action="block"), "SELECT count(*) - count(DISTINCT o_orderkey) FROM orders"),
    (
        Rule("orders", "REFERENTIAL", "o_custkey", "P1", {"parent": "customer", "parent_column": "c_custkey"}, "DQ_003"),
        "SELECT count(*) FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_custkey IS NULL",
    ),
    (Rule("orders", "ENUM_CHECK", "o_orderstatus", "P4", {"values": '["F", "O"]'}, "DQ_004", "log"), "SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')"),
    (
        Rule("lineitem", "UNIQUE", "l_orderkey,l_linenumber", "P1", rule_id="DQ_001"),
        "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) FROM lineitem",
    ),
    (
        Rule("lineitem", "RANGE_CHECK", "l_discount", "P3", {"min": "0", "max": "0.05"}, "DQ_002"),
        "SELECT count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 0.05",
    ),
    (
        Rule("lineitem", "REFERENTIAL", "l_orderkey", "P1", {"parent": "orders", "parent_column": "o_orderkey"}, "DQ_003"),
        "SELECT count(*) FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey IS NULL",
    ),
    (
        Rule("customer", "REGEX_PATTERN", "c_name", "P4", {"pattern": "^Customer#[0-9]{9}$"}, "DQ_001", "log"),
        "SELECT count(*) FROM customer WHERE NOT regexp_matches(c_name, '^Customer#[0-9]{9}$')",
    ),
    (Rule("customer", "ROW_COUNT", None, "P1", {"min": "0"}, "DQ_002"), "SELECT CASE WHEN count(*) <= 0 THEN 1 ELSE 0 END FROM customer"),
    (
        Rule("customer", "RANGE_CHECK", "c_acctbal", "P3", {"min": "0"}, "DQ_003"),
        "SELECT count(*) FROM customer WHERE c_acctbal < 0",
    ),
]


def suite_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{r.rule_id}' AS rule_id, '{r.priority}' AS priority, '{r.fail_action}' AS fail_action, "
        f"'{'_'.join([r.rule_type, *r.columns])}' AS monitoring_label, * FROM ({row_sql(r, sql)})"
        for r, sql in SUITE
    )


def suite_results(spark, sf_dir) -> DataFrame:
    t = tables(spark, sf_dir, "orders", "lineitem", "customer")
    return suite.run(t, [r for r, _ in SUITE], AS_OF)


@query("dq_suite", suite_sql())
def dq_suite(spark, sf_dir):
    """The flagship: which rules fail, and by how much?"""
    return suite.by_priority(suite_results(spark, sf_dir))


@query(
    "dq_suite_priorities",
    f"SELECT priority, count(*) AS rules, count(*) FILTER (NOT passed) AS failed FROM ({suite_sql()}) GROUP BY 1",
)
def dq_suite_priorities(spark, sf_dir):
    return suite.priority_counts(suite_results(spark, sf_dir))


ENUM_LIMIT = 20


def profiled_with_keys(spark, sf_dir) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(columns with key flags, edges, tables) of customer and order under *_id names."""
    t = tables(spark, sf_dir, "customer", "orders")
    named = {
        "customer": t["customer"].withColumnsRenamed({"c_custkey": "customer_id", "c_nationkey": "nation_id"}),
        "order": gappy_orders(spark, sf_dir).withColumnsRenamed(
            {"o_orderkey": "order_id", "o_custkey": "customer_id", "o_orderdate": "created_at"}
        ),
    }
    columns = cut(profile.profile_tables(named, k=ENUM_LIMIT))  # a few rows, used several times
    edges = keys.resolve(columns)
    flagged = keys.with_foreign_keys(keys.primary_keys(columns), edges)
    return flagged.withColumn("is_business_key", F.col("is_primary_key")), edges, named


ENUMS = "(SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM {t} WHERE {c} IS NOT NULL))"
RECOMMENDED = f"""
    SELECT * FROM (
      SELECT 'customer' AS table_name, 'NOT_NULL' AS rule_type, 'customer_id' AS column_name, 'P1' AS priority, '' AS detail
      UNION ALL SELECT 'customer', 'NOT_NULL', 'nation_id', 'P1', ''
      UNION ALL SELECT 'customer', 'ROW_COUNT', NULL, 'P1', '0'
      UNION ALL SELECT 'customer', 'UNIQUE', 'customer_id', 'P1', ''
      UNION ALL SELECT 'customer', 'RANGE_CHECK', 'c_acctbal', 'P3', CAST(min(c_acctbal) AS VARCHAR) || '|' || CAST(max(c_acctbal) AS VARCHAR) FROM customer
      UNION ALL SELECT 'customer', 'ENUM_CHECK', 'c_mktsegment', 'P4', {ENUMS.format(c='c_mktsegment', t='customer')}
      UNION ALL SELECT 'order', 'NOT_NULL', 'customer_id', 'P1', ''
      UNION ALL SELECT 'order', 'NOT_NULL', 'order_id', 'P1', ''
      UNION ALL SELECT 'order', 'REFERENTIAL', 'customer_id', 'P1', 'customer|customer_id'
      UNION ALL SELECT 'order', 'ROW_COUNT', NULL, 'P1', '0'
      UNION ALL SELECT 'order', 'UNIQUE', 'order_id', 'P1', ''
      UNION ALL SELECT 'order', 'FRESHNESS', 'created_at', 'P2', '25'
      UNION ALL SELECT 'order', 'RANGE_CHECK', 'o_totalprice', 'P3', CAST(min(o_totalprice) AS VARCHAR) || '|' || CAST(max(o_totalprice) AS VARCHAR) FROM orders
      UNION ALL SELECT 'order', 'COMPLETENESS', 'o_orderpriority', 'P2', '' FROM {GAPPY_ORDERS}
        HAVING round_even((count(*) - count(o_orderpriority)) / count(*), 4) BETWEEN 0.01 AND 0.20
      UNION ALL SELECT 'order', 'ENUM_CHECK', 'o_orderpriority', 'P4', {ENUMS.format(c='o_orderpriority', t=GAPPY_ORDERS)}
      UNION ALL SELECT 'order', 'ENUM_CHECK', 'o_orderstatus', 'P4', {ENUMS.format(c='o_orderstatus', t='orders')}
    )
"""


@query(
    "dq_recommend",
    f"""
    SELECT *, 'DQ_' || lpad(CAST(row_number() OVER (PARTITION BY table_name ORDER BY priority, rule_type, column_name NULLS FIRST) AS VARCHAR), 3, '0') AS rule_id
    FROM ({RECOMMENDED}) QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY priority, rule_type, column_name NULLS FIRST) >= 1
    """,
)
def dq_recommend(spark, sf_dir):
    columns, edges, _ = profiled_with_keys(spark, sf_dir)
    rules = recommend.recommend(columns, edges, enum_limit=ENUM_LIMIT)

    def param(name):
        return F.element_at("params", name)

    listed = F.array_join(F.from_json(param("values"), "ARRAY<STRING>"), "|")
    detail = F.concat_ws("|", listed, param("min"), param("max"), param("hours"), param("parent"), param("parent_column"))
    return rules.select("table_name", "rule_id", "rule_type", "column_name", "priority", detail.alias("detail"))


@query(
    "dq_recommend_p1_p3",
    f"SELECT table_name, rule_type, column_name FROM ({RECOMMENDED}) WHERE priority IN ('P1', 'P3')",
)
def dq_recommend_p1_p3(spark, sf_dir):
    """Chosen priorities only."""
    columns, edges, _ = profiled_with_keys(spark, sf_dir)
    return recommend.recommend(columns, edges, wanted=["P1", "P3"], enum_limit=ENUM_LIMIT).select("table_name", "rule_type", "column_name")


@query(
    "dq_recommend_run",
    f"""
    SELECT table_name, rule_type, column_name,
      CAST(CASE rule_type WHEN 'COMPLETENESS' THEN (SELECT count(*) - count(o_orderpriority) FROM {GAPPY_ORDERS})
        WHEN 'FRESHNESS' THEN 1 ELSE 0 END AS BIGINT) AS failures
    FROM (SELECT * FROM ({RECOMMENDED}) QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY priority, rule_type, column_name NULLS FIRST) >= 1)
    """,
)
def dq_recommend_run(spark, sf_dir):
    """Recommended rules, run on the tables they were derived from."""
    columns, edges, named = profiled_with_keys(spark, sf_dir)
    rules = suite.to_rules(recommend.recommend(columns, edges, enum_limit=ENUM_LIMIT))
    return suite.run(named, rules, AS_OF).select("table_name", "rule_type", "column_name", "failures")


@query(
    "dq_same_type",
    """
    SELECT 'DQ_001' AS rule_id, 'REGEX_PATTERN_source_DQ_001' AS monitoring_label, count(*) FILTER (NOT regexp_matches(source, '^src[0-9]+$')) AS failures FROM documents
    UNION ALL SELECT 'DQ_002', 'REGEX_PATTERN_source_DQ_002', count(*) FILTER (NOT regexp_matches(source, '[02468]$')) FROM documents
    UNION ALL SELECT 'DQ_003', 'NOT_NULL_source', count(*) FILTER (source IS NULL) FROM documents
    """,
)
def dq_same_type(spark, sf_dir):
    """Two patterns for one column keep labels of their own."""
    rules = [
        Rule("documents", "REGEX_PATTERN", "source", params={"pattern": "^src[0-9]+$"}, rule_id="DQ_001"),
        Rule("documents", "REGEX_PATTERN", "source", params={"pattern": "[02468]$"}, rule_id="DQ_002"),
        Rule("documents", "NOT_NULL", "source", rule_id="DQ_003"),
    ]
    return suite.run(tables(spark, sf_dir, "documents"), rules, AS_OF).select("rule_id", "monitoring_label", "failures")


@query(
    "dq_recommend_contacts",
    """
    WITH c AS (SELECT count(*) AS n, count(DISTINCT c_custkey) AS d, count(*) FILTER (c_custkey % 10 = 0) / count(*) AS gap FROM customer),
    rules AS (
      SELECT 'contact' AS t, 'P1' AS p, 'NOT_NULL' AS r, 'contact_id' AS c FROM c WHERE n = d UNION ALL SELECT 'contact', 'P1', 'UNIQUE', 'contact_id' FROM c WHERE n = d
      UNION ALL SELECT 'contact', 'P1', 'NOT_NULL', 'nation_id' UNION ALL SELECT 'contact', 'P1', 'REFERENTIAL', 'nation_id' UNION ALL SELECT 'contact', 'P1', 'ROW_COUNT', NULL
      UNION ALL SELECT 'contact', 'P2', 'COMPLETENESS', 'phone' FROM c WHERE round_even(gap, 4) BETWEEN 0.01 AND 0.2
      UNION ALL SELECT 'contact', 'P4', 'REGEX_PATTERN', 'email' UNION ALL SELECT 'contact', 'P4', 'REGEX_PATTERN', 'phone'
      UNION ALL SELECT 'nation', 'P1', 'NOT_NULL', 'nation_id' UNION ALL SELECT 'nation', 'P1', 'UNIQUE', 'nation_id' UNION ALL SELECT 'nation', 'P1', 'ROW_COUNT', NULL
      UNION ALL SELECT 'nation', 'P4', 'ENUM_CHECK', 'n_name' FROM (SELECT count(DISTINCT n_name) AS k FROM nation) WHERE k < 30
    )
    SELECT t AS table_name, r AS rule_type, c AS column_name, p AS priority, 'DQ_00' || row_number() OVER (PARTITION BY t ORDER BY p, r, c NULLS FIRST) AS rule_id FROM rules
    QUALIFY row_number() OVER (PARTITION BY t ORDER BY p, r, c NULLS FIRST) <= 7
    """,
)
def dq_recommend_contacts(spark, sf_dir):
    """Patterns by column name, a gap in a column, relationships that come twice, and at most seven rules per table."""
    _, rules = contact_rules(spark, sf_dir, max_rules=7)
    return rules.select("table_name", "rule_type", "column_name", "priority", "rule_id")


def contact_rules(spark, sf_dir, **options):
    """Customers as contacts with their nations, and the rules recommended for them."""
    t = tables(spark, sf_dir, "customer", "nation")
    key = F.col("c_custkey")
    contact = t["customer"].select(
        key.alias("contact_id"), F.concat(F.lit("c"), key.cast("string"), F.when(key % 7 != 3, F.lit("@example.com")).otherwise(F.lit(" at example"))).alias("email"),
        F.when(key % 10 != 0, F.concat(F.lit("+49 "), (key + 1_000_000).cast("string"))).alias("phone"), F.col("c_nationkey").alias("nation_id"),
    )
    nation = t["nation"].select(F.col("n_nationkey").alias("nation_id"), "n_name")
    named = {"contact": contact, "nation": nation}
    columns = cut(profile.profile_tables(named, k=30))
    edges = keys.resolve(columns)
    flagged = keys.with_foreign_keys(keys.primary_keys(columns), edges)
    rules = recommend.recommend(flagged.withColumn("is_business_key", F.lit(False)), edges.unionByName(edges), enum_limit=30, **options)
    return named, rules


@query(
    "dq_statements",
    """
    SELECT table_name, rule_type, column_name, CAST(CASE WHEN rule_type = 'COMPLETENESS' THEN (SELECT count(*) FROM customer WHERE c_custkey % 10 = 0)
      WHEN column_name = 'email' THEN (SELECT count(*) FROM customer WHERE c_custkey % 7 = 3)
      WHEN rule_type = 'REFERENTIAL' THEN (SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey <> 4)) ELSE 0 END AS BIGINT) AS failures
    FROM (VALUES ('contact', 'NOT_NULL', 'contact_id'), ('contact', 'UNIQUE', 'contact_id'), ('contact', 'NOT_NULL', 'nation_id'), ('contact', 'REFERENTIAL', 'nation_id'),
      ('contact', 'ROW_COUNT', NULL), ('contact', 'COMPLETENESS', 'phone'), ('contact', 'REGEX_PATTERN', 'email'), ('contact', 'REGEX_PATTERN', 'phone'),
      ('nation', 'NOT_NULL', 'nation_id'), ('nation', 'UNIQUE', 'nation_id'), ('nation', 'ROW_COUNT', NULL), ('nation', 'ENUM_CHECK', 'n_name')) t(table_name, rule_type, column_name)
    """,
)
def dq_statements(spark, sf_dir):
    """Recommended rules as SQL statements, run on tables that a nation has left since."""
    named, rules = contact_rules(spark, sf_dir)
    schema, _ = scratch_schema(spark)
    for name, df in named.items():
        sinks.full_refresh(df.filter("nation_id <> 4") if name == "nation" else df, f"{schema}.{name}")
    found = None
    for r in recommend.sql_text(rules, schema).collect():  # a few rules
        failures = spark.sql(r["sql"]).toDF("failures").select(F.col("failures").cast("bigint").alias("failures"))
        one = failures.select(F.lit(r["table_name"]).alias("table_name"), F.lit(r["rule_type"]).alias("rule_type"), F.lit(r["column_name"]).cast("string").alias("column_name"), "failures")
        found = one if found is None else found.unionByName(one)
    return found


@query(
    "dq_quarantine",
    """
    SELECT CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'ENUM_CHECK_o_orderstatus' ELSE '' END
      || CASE WHEN o_orderstatus NOT IN ('F', 'O') AND o_totalprice > 400000 THEN ',' ELSE '' END
      || CASE WHEN o_totalprice > 400000 THEN 'RANGE_CHECK_o_totalprice' ELSE '' END AS broken,
      count(*) AS n FROM orders GROUP BY 1
    """,
)
def dq_quarantine(spark, sf_dir):
    rules = [
        Rule("orders", "ENUM_CHECK", "o_orderstatus", params={"values": ["F", "O"]}),
        Rule("orders", "RANGE_CHECK", "o_totalprice", params={"max": "400000"}),
    ]
    marked = suite.quarantine(table(spark, sf_dir, "orders"), rules)
    return marked.groupBy(F.array_join("broken_rules", ",").alias("broken")).agg(F.count("*").alias("n"))


@query(
    "dq_null_cover",
    " UNION ALL ".join(
        f"SELECT 'orders' AS table_name, 'COMPLETENESS' AS rule_type, '{c}' AS column_name, "
        f"count(*) - count({c}) AS failures, count(*) = count({c}) AS passed FROM {GAPPY_ORDERS}"
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    ),
)
def dq_null_cover(spark, sf_dir):
    orders = gappy_orders(spark, sf_dir)
    return rows_of(suite.run({"orders": orders}, suite.null_cover("orders", orders), AS_OF))


BOUNDARY_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]
WHOLE_COLUMNS = {"l_orderkey": 2**63 - 1, "l_partkey": 2**63 - 1, "l_suppkey": 2**63 - 1, "l_linenumber": 2**31 - 1}


@query(
    "dq_boundary_cover",
    " UNION ALL ".join(
        [
            "SELECT 'lineitem' AS table_name, 'EMPTY_SOURCE' AS rule_type, CAST(NULL AS VARCHAR) AS column_name, "
            "CAST(CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS BIGINT) AS failures FROM lineitem"
        ]
        + [
            f"SELECT 'lineitem', 'ALL_NULL', '{c}', CAST(CASE WHEN count(*) > 0 AND count({c}) = 0 THEN 1 ELSE 0 END AS BIGINT) FROM lineitem"
            for c in BOUNDARY_COLUMNS
        ]
        + [f"SELECT 'lineitem', 'NUMERIC_MAX', '{c}', count(*) FILTER ({c} = {top}) FROM lineitem" for c, top in WHOLE_COLUMNS.items()]
    ),
)
def dq_boundary_cover(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    results = suite.run({"lineitem": lines}, suite.boundary_cover("lineitem", lines), AS_OF)
    return results.select("table_name", "rule_type", "column_name", "failures")


@query(
    "dq_attach",
    """
    SELECT DISTINCT p_brand AS table_name, 'NOT_NULL' AS rule_type, 'p_name' AS column_name, 'P1' AS priority FROM part
    UNION ALL SELECT DISTINCT p_brand, 'RANGE_CHECK', 'p_size', 'P3' FROM part
    """,
)
def dq_attach(spark, sf_dir):
    """Stored rule documents joined to their tables: here one document per brand."""
    part = table(spark, sf_dir, "part")
    brands = part.select(F.col("p_brand").alias("table_name")).distinct()
    doc = (
        '[{"rule_type":"NOT_NULL","column":"p_name","priority":"P1"},'
        '{"rule_type":"RANGE_CHECK","column":"p_size","priority":"P3","params":{"min":"1","max":"50"}}]'
    )
    attached = suite.attach(brands.withColumn("rules", F.lit(doc)), brands)
    return attached.select("table_name", "rule_type", "column_name", "priority")


@query(
    "recon_row_counts",
    "SELECT (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM lineitem) AS target_rows, "
    "abs((SELECT count(*) FROM orders) - (SELECT count(*) FROM lineitem)) AS difference",
)
def recon_row_counts(spark, sf_dir):
    t = tables(spark, sf_dir, "orders", "lineitem")
    return recon.row_counts(t["orders"], t["lineitem"])


@query(
    "recon_measures",
    """
    WITH s AS (SELECT o_orderkey AS k, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS a FROM orders GROUP BY 1),
      t AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS b FROM lineitem GROUP BY 1)
    SELECT coalesce(s.k, t.k) AS k, CAST(a AS DOUBLE) AS amount_source, CAST(b AS DOUBLE) AS amount_target
    FROM s FULL JOIN t ON s.k = t.k WHERE a IS NULL OR b IS NULL OR abs(a - b) > 1000
    """,
)
def recon_measures(spark, sf_dir):
    """Order totals against their line items, tolerance 1000."""
    t = tables(spark, sf_dir, "orders", "lineitem")
    source = t["orders"].select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    target = t["lineitem"].select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").cast("decimal(18,2)").alias("v"))
    off = recon.measures(source, target, ["k"], {"amount": "v"}, tolerance=1000)
    return off.select("k", F.col("amount_source").cast("double").alias("amount_source"), F.col("amount_target").cast("double").alias("amount_target"))


@query(
    "recon_row_difference",
    """
    SELECT l_orderkey, l_linenumber, CAST(sum(s) AS BIGINT) AS copies FROM (
      SELECT l_orderkey, l_linenumber, 1 AS s FROM lineitem
      UNION ALL SELECT DISTINCT l_orderkey, l_linenumber, -1 FROM lineitem)
    GROUP BY 1, 2 HAVING sum(s) <> 0
    """,
)
def recon_row_difference(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return recon.row_difference(lines, lines.distinct())


ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
#: Orders as a copy with faults holds them: some prices changed, some rows missing, some twice, some new.
FAULTY_ORDERS = """
    SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 97 = 5 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
      o_orderdate, nullif(o_orderpriority, CASE WHEN o_orderkey % 101 = 7 THEN o_orderpriority END) AS o_orderpriority FROM {orders} WHERE o_orderkey % 103 <> 9
    UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM {orders} WHERE o_orderkey % 211 = 3
    UNION ALL SELECT -1 - o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM {orders} WHERE o_orderkey % 307 = 11
"""


@query(
    "recon_digests",
    f"""
    SELECT {ORDER_COLUMNS.replace('o_orderdate', 'CAST(o_orderdate AS VARCHAR) AS o_orderdate')}, CAST(sum(s) AS BIGINT) AS copies FROM (
      SELECT {ORDER_COLUMNS}, 1 AS s FROM orders UNION ALL SELECT {ORDER_COLUMNS}, -1 FROM ({FAULTY_ORDERS.format(orders='orders')}))
    GROUP BY ALL HAVING sum(s) <> 0
    """,
)
def recon_digests(spark, sf_dir):
    """EXCEPT ALL both ways from digests kept beside two stored tables; only differing ranges are read."""
    orders = table(spark, sf_dir, "orders")
    faulty = spark.sql(FAULTY_ORDERS.format(orders="{orders}"), orders=orders)
    sides = []
    for df in (orders, faulty):
        path = scratch(spark, "orders-by-range")
        digests.store(df, ["o_orderkey"], 256, path)
        sides.append((spark.read.parquet(path), spark.read.parquet(f"{path}-digests")))
    (left, left_digests), (right, right_digests) = sides
    found = digests.difference(left, right, ["o_orderkey"], 256, left_digests, right_digests)
    return found.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query("recon_idempotency", "SELECT CAST(0 AS BIGINT) AS differing_rows, (SELECT count(*) + 1 FROM customer) AS hub_rows")
def recon_idempotency(spark, sf_dir):
    """A hub loaded twice: the second load appends nothing, so both states agree."""
    customer = table(spark, sf_dir, "customer")
    source = vault.Source(customer, ["c_custkey"], "crm.customer", "2024-01-01")
    once = vault.hub("customer", [source], ["c_custkey"])
    again = once.unionByName(vault.hub("customer", [source], ["c_custkey"], existing=once))
    differing = recon.row_difference(once, again).agg(F.count("*").alias("differing_rows"))
    return differing.select("differing_rows", again.agg(F.count("*")).scalar().alias("hub_rows"))


MAPPING = mapping.Mapping(
    "customer",
    "DIM_CUSTOMER",
    [
        mapping.ColumnMapping("DERIVED", "customer_hk", "string", "sha2(upper(trim(cast(c_custkey AS string))), 256)"),
        mapping.ColumnMapping("c_custkey", "customer_id", "bigint"),
        mapping.ColumnMapping("DERIVED", "customer_name", "string", "upper(c_name)"),
        mapping.ColumnMapping("c_acctbal", "balance", "double", "cast(cast(c_acctbal AS decimal(18,1)) AS double)"),
        mapping.ColumnMapping("DERIVED", "nation_name", "string", "other.n_name"),
        mapping.ColumnMapping("c_mktsegment", "segment_no", "int", nullable=False),
    ],
    filter="c_acctbal > 0",
    join="source.c_nationkey = other.n_nationkey",
)


@query("mapping_unmapped", "SELECT c AS column_name, (SELECT count(*) FROM customer) AS n FROM (VALUES ('customer_id'), ('phone'), ('load_note')) t(c) WHERE c <> 'customer_id'")
def mapping_unmapped(spark, sf_dir):
    """Columns of a target that its mapping does not fill, with the rows they would leave empty."""
    target = T.StructType([T.StructField(c, T.StringType()) for c in ("customer_hk", "customer_id", "phone", "load_note", *mapping.STANDARD_COLUMNS)])
    missing = spark.createDataFrame([(c,) for c in mapping.unmapped(target, MAPPING)], "column_name string")
    return missing.withColumn("n", table(spark, sf_dir, "customer").agg(F.count("*")).scalar())


@query(
    "mapping_apply",
    """
    SELECT sha256(CAST(c_custkey AS VARCHAR)) AS customer_hk, c_custkey AS customer_id, upper(c_name) AS customer_name,
      CAST(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DECIMAL(18,1)) AS DOUBLE) AS balance, n_name AS nation_name, CAST(NULL AS INTEGER) AS segment_no,
      '2024-01-01 00:00:00' AS load_date, 'crm.customer' AS record_source
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0
    """,
)
def mapping_apply(spark, sf_dir):
    t = tables(spark, sf_dir, "customer", "nation")
    out = mapping.apply(t["customer"], MAPPING, "2024-01-01", "crm.customer", other=t["nation"])
    return out.withColumn("load_date", F.col("load_date").cast("string"))


@query(
    "mapping_rejects",
    " UNION ALL ".join(
        f"SELECT '{m.target_column}' AS target_column, count(*) * {int(m.target_column == 'segment_no')} AS cast_failures, "
        f"count(*) * {int(m.target_column == 'segment_no')} AS null_failures FROM customer WHERE c_acctbal > 0"
        for m in MAPPING.columns
    ),
)
def mapping_rejects(spark, sf_dir):
    t = tables(spark, sf_dir, "customer", "nation")
    return mapping.rejects(t["customer"], MAPPING, other=t["nation"])


@query(
    "recon_faults",
    """
    WITH c AS (SELECT c_custkey % 11 = 3 AS gone, c_custkey % 9 = 2 AS changed FROM customer WHERE c_acctbal > 0)
    SELECT 'functional' AS test, CAST(sum(CASE WHEN gone THEN 1 WHEN changed THEN 2 ELSE 0 END) AS BIGINT) AS differing_rows FROM c
    UNION ALL SELECT 'idempotency', count(*) FROM (SELECT DISTINCT c_custkey FROM customer)
    """,
)
def recon_faults(spark, sf_dir):
    """The functional test on a target with changed and missing rows, and a hub whose second load does not look at the first."""
    t = tables(spark, sf_dir, "customer", "nation")
    mapped = cut(mapping.apply(t["customer"], MAPPING, "2024-01-01", "crm.customer", other=t["nation"]))
    faulty = mapped.filter("customer_id % 11 <> 3").withColumn("balance", F.when(F.col("customer_id") % 9 == 2, F.col("balance") + 1).otherwise(F.col("balance")))
    source = vault.Source(t["customer"], ["c_custkey"], "crm.customer", "2024-01-01")
    once = cut(vault.hub("customer", [source], ["c_custkey"], with_ghost=False))
    found = None
    for name, first, second in (("functional", mapped, faulty), ("idempotency", once, once.unionByName(once))):
        one = recon.row_difference(first, second).agg(F.count("*").alias("differing_rows")).select(F.lit(name).alias("test"), "differing_rows")
        found = one if found is None else found.unionByName(one)
    return found


@query("recon_functional", "SELECT count(*) AS target_rows, CAST(0 AS BIGINT) AS differing_rows FROM customer WHERE c_acctbal > 0")
def recon_functional(spark, sf_dir):
    """The mapped rows agree with a target that was built another way."""
    t = tables(spark, sf_dir, "customer", "nation")
    mapped = mapping.apply(t["customer"], MAPPING, "2024-01-01", "crm.customer", other=t["nation"])
    t["customer"].createOrReplaceTempView("sw_customer")
    t["nation"].createOrReplaceTempView("sw_nation")
    target = spark.sql(
        "SELECT sha2(cast(c_custkey AS string), 256) AS customer_hk, c_custkey AS customer_id, upper(c_name) AS customer_name, "
        "cast(cast(c_acctbal AS decimal(18,1)) AS double) AS balance, n_name AS nation_name, cast(NULL AS int) AS segment_no, "
        "timestamp_ntz'2024-01-01' AS load_date, 'crm.customer' AS record_source "
        "FROM sw_customer LEFT JOIN sw_nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0"
    )
    differing = recon.row_difference(mapped, target).agg(F.count("*").alias("differing_rows"))
    return target.agg(F.count("*").alias("target_rows")).select("target_rows", differing.scalar().alias("differing_rows"))
