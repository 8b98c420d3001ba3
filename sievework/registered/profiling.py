"""Profiles, keys, catalog and file scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators import keys, profile, sketches
from sievework.registered.registry import query, scratch_schema, table, tables
from sievework.session import cut, scratch
from sievework.sources import catalog, files, metadata, sinks

# (column, type, is a number) per table
COLUMNS = {
    "region": [("r_regionkey", "int", 1), ("r_name", "string", 0)],
    "nation": [("n_nationkey", "int", 1), ("n_name", "string", 0), ("n_regionkey", "int", 1)],
    "customer": [
        ("c_custkey", "bigint", 1), ("c_name", "string", 0), ("c_nationkey", "int", 1),
        ("c_acctbal", "double", 1), ("c_mktsegment", "string", 0),
    ],
    "supplier": [
        ("s_suppkey", "bigint", 1), ("s_name", "string", 0), ("s_nationkey", "int", 1), ("s_acctbal", "double", 1),
    ],
    "part": [
        ("p_partkey", "bigint", 1), ("p_name", "string", 0), ("p_brand", "string", 0), ("p_type", "string", 0),
        ("p_size", "int", 1), ("p_retailprice", "double", 1),
    ],
    "orders": [
        ("o_orderkey", "bigint", 1), ("o_custkey", "bigint", 1), ("o_orderstatus", "string", 0),
        ("o_totalprice", "double", 1), ("o_orderdate", "timestamp_ntz", 0), ("o_orderpriority", "string", 0),
    ],
    "lineitem": [
        ("l_orderkey", "bigint", 1), ("l_partkey", "bigint", 1), ("l_suppkey", "bigint", 1),
        ("l_linenumber", "int", 1), ("l_quantity", "double", 1), ("l_extendedprice", "double", 1),
        ("l_discount", "double", 1), ("l_tax", "double", 1), ("l_returnflag", "string", 0),
        ("l_linestatus", "string", 0), ("l_shipdate", "timestamp_ntz", 0),
    ],
}


def column_sql(name: str, relation: str, ordinal: int, column: str, dtype: str, number: int, width: int) -> str:
    def num(fn: str) -> str:
        return f"{fn}(CAST({column} AS DOUBLE))" if number else "CAST(NULL AS DOUBLE)"

    return f"""
      SELECT '{name}' AS table_name, count(*) AS row_count, {width} AS column_count, {ordinal} AS ordinal,
        '{column}' AS name, '{dtype}' AS data_type, count(*) - count({column}) AS null_count,
        round_even((count(*) - count({column})) / greatest(count(*), 1), 4) AS null_pct,
        count(DISTINCT {column}) AS distinct_count,
        coalesce((SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST({column} AS VARCHAR) AS v
          FROM {relation} WHERE {column} IS NOT NULL ORDER BY v LIMIT 5)), '') AS samples,
        {num('min')} AS min_num, {num('max')} AS max_num, round({num('avg')} + 1e-9, 6) AS avg_num
      FROM {relation}"""


def profile_sql(name: str, relation: str | None = None) -> str:
    columns = COLUMNS[name]
    return " UNION ALL ".join(
        column_sql(name, relation or name, i, *c, len(columns)) for i, c in enumerate(columns)
    )


def shown(columns: DataFrame) -> DataFrame:
    return columns.select(
        "table_name", "row_count", "column_count", "ordinal", "name", "data_type", "null_count", "null_pct",
        "distinct_count", F.array_join("sample_values", "|").alias("samples"),
        F.col("min_num").cast("double").alias("min_num"), F.col("max_num").cast("double").alias("max_num"),
        F.round(F.col("avg_num") + 1e-9, 6).alias("avg_num"),  # off the ties, where summing order would show
    )


GAPPY_ORDERS = "(SELECT * REPLACE (nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority) FROM orders)"


def gappy_orders(spark, sf_dir) -> DataFrame:
    """Orders whose unspecified priority is NULL."""
    return table(spark, sf_dir, "orders").withColumn(
        "o_orderpriority", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED"))
    )


@query("profile_orders", profile_sql("orders", GAPPY_ORDERS))
def profile_orders(spark, sf_dir):
    return shown(profile.profile(gappy_orders(spark, sf_dir), "orders"))


@query("profile_lineitem", profile_sql("lineitem"))
def profile_lineitem(spark, sf_dir):
    return shown(profile.profile(table(spark, sf_dir, "lineitem"), "lineitem"))


@query("profile_batch", " UNION ALL ".join(profile_sql(name) for name in COLUMNS))
def profile_batch(spark, sf_dir):
    return shown(profile.profile_tables(tables(spark, sf_dir, *COLUMNS)))


@query(
    "profile_summary",
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, CAST({len(columns)} AS BIGINT) AS column_count, count(*) AS row_count, "
        f"CAST(0 AS BIGINT) AS fk_links, true AS has_stats FROM {name}"
        for name, columns in COLUMNS.items()
    ),
)
def profile_summary(spark, sf_dir):
    return profile.summary(profile.profile_tables(tables(spark, sf_dir, *COLUMNS)))


#: The tables beside the star schema.
MORE = {
    "events": [("event_id", "bigint", 1), ("ts", "timestamp_ntz", 0), ("user_id", "bigint", 1), ("event_type", "string", 0), ("props", "string", 0)],
    "documents": [("doc_id", "bigint", 1), ("text", "string", 0), ("lang", "string", 0), ("source", "string", 0), ("n_chars", "bigint", 1)],
    "embeddings": [("vec_id", "bigint", 1), ("label", "int", 1)],
    "pages": [("page_id", "bigint", 1), ("url", "string", 0), ("html", "string", 0)],
    "benchmark": [("item_id", "bigint", 1), ("text", "string", 0)],
    "labels": [("doc_id", "bigint", 1), ("quality", "int", 1), ("toxic", "int", 1)],
    "conversations": [("conv_id", "bigint", 1), ("turn", "bigint", 1), ("role", "string", 0), ("text", "string", 0)],
}


@query(
    "profile_corpus",
    " UNION ALL ".join(
        column_sql(name, name, i, *c, len(columns)) for name, columns in MORE.items() for i, c in enumerate(columns)
    ),
)
def profile_corpus(spark, sf_dir):
    """The tables of texts, events and labels."""
    return shown(profile.profile_tables({t: table(spark, sf_dir, t).select(*[c for c, _, _ in columns]) for t, columns in MORE.items()}))


@query(
    "profile_files",
    " UNION ALL ".join(f"SELECT '{fmt}' AS format, table_name, name, row_count, null_count, distinct_count, samples FROM ({profile_sql('customer')})" for fmt in ("csv", "json", "parquet")),
)
def profile_files(spark, sf_dir):
    """A folder of each format, read and profiled in one call."""
    customer = table(spark, sf_dir, "customer")
    found = None
    for fmt in ("csv", "json", "parquet"):
        path = f"{scratch(spark, fmt)}/customer.{fmt}"
        if fmt == "parquet":
            customer.write.parquet(path)
        else:
            sinks.write_result(customer, path, fmt)
        one = profile.profile_path(spark, path, fmt, None if fmt == "parquet" else customer.schema).withColumn("format", F.lit(fmt))
        found = one if found is None else found.unionByName(one)
    return found.select("format", "table_name", "name", "row_count", "null_count", "distinct_count", F.array_join("sample_values", "|").alias("samples"))


@query(
    "profile_approx",
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, count(*) AS row_count, count(*) - count({c}) AS null_count, true AS near_exact FROM lineitem"
        for c, _, _ in COLUMNS["lineitem"]
    ),
)
def profile_approx(spark, sf_dir):
    """Sketched distinct counts lie within 20% of the exact ones."""
    df = table(spark, sf_dir, "lineitem")
    rough = profile.profile(df, "lineitem", approx=True)
    exact = profile.profile(df, "lineitem").select("name", F.col("distinct_count").alias("exact_count"))
    off = F.abs(F.col("distinct_count") - F.col("exact_count")) / F.col("exact_count")
    return rough.join(exact, "name").select("name", "row_count", "null_count", (off < 0.2).alias("near_exact"))


def drawn_sql(relation: str, column: str, seed: int, k: int = 5) -> str:
    """The k values of a column with the smallest hashes, joined."""
    return f"""coalesce((SELECT string_agg(v, '|' ORDER BY md5('{seed}:' || v)) FROM (SELECT DISTINCT CAST({column} AS VARCHAR) AS v
      FROM {relation} WHERE {column} IS NOT NULL ORDER BY md5('{seed}:' || v) LIMIT {k})), '')"""


DRAWN = {"orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"], "documents": ["doc_id", "text", "lang", "source"]}


@query(
    "profile_approx_samples",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS name, count(*) AS row_count, count(*) - count({c}) AS null_count, {drawn_sql(r, c, 3)} AS samples FROM {r}"
        for t, r in (("orders", GAPPY_ORDERS), ("documents", "documents")) for c in DRAWN[t]
    ),
)
def profile_approx_samples(spark, sf_dir):
    """Sketched profiles with samples by hash; long texts and NULLs among them."""
    found = None
    for name, df in (("orders", gappy_orders(spark, sf_dir)), ("documents", table(spark, sf_dir, "documents"))):
        one = profile.profile(df.select(*DRAWN[name]), name, approx=True, seed=3)
        found = one if found is None else found.unionByName(one)
    return found.select("table_name", "name", "row_count", "null_count", F.array_join("sample_values", "|").alias("samples"))


SAMPLED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
SAMPLE_SQL = f"""(SELECT {', '.join(SAMPLED)} FROM orders ORDER BY md5('11:{{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey
  || ',"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '"}}') LIMIT 700)"""


@query("sample_rows", f"SELECT * FROM {SAMPLE_SQL}")
def sample_rows(spark, sf_dir):
    """Seven hundred orders, the same whatever the partitioning."""
    return files.sample_rows(table(spark, sf_dir, "orders").select(*SAMPLED).repartition(13), 700, seed=11)


@query(
    "profile_sampled",
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, (SELECT count(*) FROM orders) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count FROM {SAMPLE_SQL}"
        for c in SAMPLED
    ),
)
def profile_sampled(spark, sf_dir):
    """The profile of a sample, with the row count of the whole table."""
    found = profile.profile(table(spark, sf_dir, "orders").select(*SAMPLED), "orders", sample_rows=700, seed=11)
    return found.select("name", "row_count", "null_count", "distinct_count")


QUANTILES = [0.1, 0.5, 0.9]
UNTAXED = "(SELECT * REPLACE (CASE WHEN l_linenumber < 7 THEN l_tax END AS l_tax) FROM lineitem)"


@query(
    "profile_united",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS name, count(*) AS row_count, count(*) - count({c}) AS null_count,
          round_even((count(*) - count({c})) / greatest(count(*), 1), 4) AS null_pct,
          {f"min(CAST({c} AS DOUBLE))" if n else "CAST(NULL AS DOUBLE)"} AS min_num, {f"max(CAST({c} AS DOUBLE))" if n else "CAST(NULL AS DOUBLE)"} AS max_num,
          {f"round(avg(CAST({c} AS DOUBLE)), 4)" if n else "CAST(NULL AS DOUBLE)"} AS avg_num, CAST(0 AS BIGINT) AS distinct_off, CAST(0 AS BIGINT) AS quantiles_off FROM {UNTAXED}"""
        for c, _, n in COLUMNS["lineitem"]
    ),
)
def profile_united(spark, sf_dir):
    """lineitem profiled month by month, in two loads of months, united from the stored states.

    distinct_off: by how many standard errors over three the estimate is away from the count; quantiles_off:
    how many quantiles lie outside the sketch's rank error.
    """
    lines = table(spark, sf_dir, "lineitem").withColumn("l_tax", F.when(F.col("l_linenumber") < 7, F.col("l_tax")))
    schema, _ = scratch_schema(spark)
    states = f"{schema}.column_states"
    month = F.date_format("l_shipdate", "yyyy-MM")
    for early in (F.month("l_shipdate") <= 6, F.month("l_shipdate") > 6):
        sinks.append(sketches.column_states(lines.filter(early), {"month": month}), states)
    whole = cut(sketches.profiles(sketches.unite(spark.table(states)), QUANTILES))
    found = {r["name"]: r["quantiles"] for r in whole.select("name", "quantiles").collect() if r["quantiles"]}
    # What the estimates are held against: exact counts, and exact shares of rows below and up to each quantile.
    facts = []
    for c, _, _ in COLUMNS["lineitem"]:
        known = F.count(c)
        off = [
            ((F.count_if(F.col(c) < q) / known > p + sketches.RANK_ERROR) | (F.count_if(F.col(c) <= q) / known < p - sketches.RANK_ERROR)).cast("long")
            for p, q in zip(QUANTILES, found.get(c, []))
        ]
        facts.append(F.struct(F.lit(c).alias("name"), sum(off, F.lit(0).cast("long")).alias("quantiles_off")))
    exact = lines.agg(F.array(*facts).alias("all")).select(F.inline("all"))
    # Each column is read and shuffled by itself: all distinct counts in one aggregate take every row once a column, as wide as the row.
    counts = [lines.select(F.col(c).alias("v")).distinct().agg(F.count("v").alias("exact")).select(F.lit(c).alias("name"), "exact") for c, _, _ in COLUMNS["lineitem"]]
    exact = exact.join(reduce(DataFrame.unionByName, counts), "name")
    errors = F.abs(F.col("distinct_count") - F.col("exact")) / F.col("exact") / sketches.RELATIVE_ERROR
    return whole.join(exact, "name").select(
        "name", "row_count", "null_count", "null_pct", "min_num", "max_num", F.round("avg_num", 4).alias("avg_num"),
        F.ceil(F.greatest(errors - 3, F.lit(0.0))).alias("distinct_off"), "quantiles_off",
    )


@query(
    "profile_fallback",
    """
    SELECT 'customer' AS table_name, 'c_custkey' AS name, 'live' AS stats_source,
      count(DISTINCT c_custkey) AS distinct_count, CAST(0.0 AS DOUBLE) AS null_pct FROM customer
    UNION ALL SELECT 'customer', 'c_mktsegment', 'live', count(DISTINCT c_mktsegment), CAST(0.0 AS DOUBLE) FROM customer
    UNION ALL SELECT 'archive', 'c_custkey', 'metadata', count(DISTINCT c_custkey), CAST(0.25 AS DOUBLE) FROM customer
    UNION ALL SELECT 'archive', 'c_mktsegment', 'none', NULL, NULL
    """,
)
def profile_fallback(spark, sf_dir):
    """customer is live; archive is known from an inventory only, with statistics for one column."""
    live = profile.profile(table(spark, sf_dir, "customer"), "customer").filter(
        F.col("name").isin("c_custkey", "c_mktsegment")
    )
    same = live.drop("null_pct", "distinct_count", "sample_values")
    bare = [
        F.lit(None).cast("double").alias("null_pct"),
        F.lit(None).cast("bigint").alias("distinct_count"),
        F.array().cast("array<string>").alias("sample_values"),
    ]
    archive = live.withColumn("table_name", F.lit("archive")).withColumn("null_pct", F.lit(0.25))
    first = F.col("name") == "c_custkey"
    archive = archive.select(
        "table_name", "row_count", "ordinal", "name", "data_type", "nullable",
        F.when(first, F.col("null_pct")).alias("null_pct"),
        F.when(first, F.col("distinct_count")).alias("distinct_count"),
        F.array().cast("array<string>").alias("sample_values"),
    )
    inventory = same.select("table_name", "row_count", "ordinal", "name", "data_type", "nullable", *bare)
    out = profile.with_fallback(live, inventory.unionByName(archive))
    return out.select("table_name", "name", "stats_source", "distinct_count", "null_pct")


@query(
    "profile_cap",
    " UNION ALL ".join(
        f"SELECT 'lineitem' AS table_name, '{c}' AS name, (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT "
        f"CAST({c} AS VARCHAR) AS v FROM lineitem ORDER BY v LIMIT 2)) AS samples"
        for c, _, _ in COLUMNS["lineitem"][:5]
    ),
)
def profile_cap(spark, sf_dir):
    columns = profile.profile(table(spark, sf_dir, "lineitem"), "lineitem")
    capped = profile.cap(columns, max_columns=5, max_samples=2)
    return capped.select("table_name", "name", F.array_join("sample_values", "|").alias("samples"))


def renamed_columns(spark, sf_dir) -> DataFrame:
    """Profiles of customer, order and nation under *_id names."""
    t = tables(spark, sf_dir, "customer", "orders", "nation")
    return profile.profile_tables(
        {
            "customer": t["customer"].selectExpr("c_custkey AS customer_id", "c_name AS name", "c_nationkey AS nation_id"),
            "order": t["orders"].selectExpr(
                "o_orderkey AS order_id", "o_custkey AS customer_id", "o_orderstatus AS status_code",
                "o_custkey AS clerk_id",
            ),
            "nation": t["nation"].selectExpr("n_nationkey AS nation_key", "n_regionkey AS region_id"),
        }
    )


@query(
    "keys_fk_resolution",
    """
    SELECT 'customer' AS from_table, 'nation_id' AS from_column, 'nation' AS to_table, '?' AS to_column, 'medium' AS confidence,
      count(DISTINCT c_nationkey) AS distinct_count, count(*) AS row_count FROM customer
    UNION ALL SELECT 'order', 'customer_id', 'customer', 'customer_id', 'high', count(DISTINCT o_custkey), count(*) FROM orders
    UNION ALL SELECT 'order', 'clerk_id', 'clerk', 'clerk_id', 'low', count(DISTINCT o_custkey), count(*) FROM orders
    UNION ALL SELECT 'nation', 'region_id', 'region', 'region_id', 'low', count(DISTINCT n_regionkey), count(*) FROM nation
    """,
)
def keys_fk_resolution(spark, sf_dir):
    """References of all three confidences, with the values they hold."""
    columns = cut(renamed_columns(spark, sf_dir))  # a row per column, used three times
    held = columns.select(F.col("table_name").alias("from_table"), F.col("name").alias("from_column"), "distinct_count", "row_count")
    return keys.resolve(columns).join(held, ["from_table", "from_column"])


@query(
    "keys_flags",
    """
    SELECT 'customer' AS table_name, 'customer_id' AS name, count(*) > 0 AND count(DISTINCT c_custkey) = count(*)
      AS is_primary_key, false AS is_foreign_key, CAST(NULL AS VARCHAR) AS fk_references, true AS likely_pk, false AS likely_fk
      FROM customer
    UNION ALL SELECT 'customer', 'name', false, false, NULL, false, false
    UNION ALL SELECT 'customer', 'nation_id', false, true, 'nation.?', false, true
    UNION ALL SELECT 'order', 'order_id', count(*) > 0 AND count(DISTINCT o_orderkey) = count(*), false, NULL, true, false FROM orders
    UNION ALL SELECT 'order', 'customer_id', false, true, 'customer.customer_id', false, true
    UNION ALL SELECT 'order', 'status_code', false, false, NULL, false, false
    UNION ALL SELECT 'order', 'clerk_id', false, true, 'clerk (not loaded)', false, true
    UNION ALL SELECT 'nation', 'nation_key', false, false, NULL, false, false
    UNION ALL SELECT 'nation', 'region_id', false, true, 'region (not loaded)', false, true
    """,
)
def keys_flags(spark, sf_dir):
    columns = renamed_columns(spark, sf_dir)
    flagged = keys.with_foreign_keys(keys.primary_keys(columns), keys.resolve(columns))
    return profile.likely_keys(flagged).select(
        "table_name", "name", "is_primary_key", "is_foreign_key", "fk_references", "likely_pk", "likely_fk"
    )


@query(
    "keys_business_candidates",
    """
    SELECT 'customer' AS table_name, 'customer_id' AS name, count(DISTINCT c_custkey) AS distinct_count FROM customer
    UNION ALL SELECT 'customer', 'nation_id', count(DISTINCT c_nationkey) FROM customer
    UNION ALL SELECT 'order', 'order_id', count(DISTINCT o_orderkey) FROM orders
    UNION ALL SELECT 'order', 'customer_id', count(DISTINCT o_custkey) FROM orders
    UNION ALL SELECT 'order', 'status_code', count(DISTINCT o_orderstatus) FROM orders
    UNION ALL SELECT 'order', 'clerk_id', count(DISTINCT o_custkey) FROM orders
    UNION ALL SELECT 'nation', 'nation_key', count(DISTINCT n_nationkey) FROM nation
    UNION ALL SELECT 'nation', 'region_id', count(DISTINCT n_regionkey) FROM nation
    """,
)
def keys_business_candidates(spark, sf_dir):
    found = keys.business_key_candidates(renamed_columns(spark, sf_dir))
    return found.select("table_name", "name", "distinct_count")


@query(
    "keys_inclusion",
    """
    SELECT count(DISTINCT doc_id) AS child_keys,
      count(DISTINCT doc_id) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS missing_keys,
      count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS missing_rows FROM documents
    """,
)
def keys_inclusion(spark, sf_dir):
    t = tables(spark, sf_dir, "documents", "labels")
    return keys.unmatched(t["documents"], "doc_id", t["labels"], "doc_id")


#: Comparable columns of all tables, by the families in which values can be equal.
FAMILIES = {
    **{t: [(c, {"int": "whole", "bigint": "whole", "double": "fraction", "timestamp_ntz": "time"}.get(d, d)) for c, d, _ in columns] for t, columns in COLUMNS.items()},
    "events": [("event_id", "whole"), ("ts", "time"), ("user_id", "whole"), ("event_type", "string"), ("value", "fraction"), ("props", "string")],
    "documents": [("doc_id", "whole"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "whole")],
    "embeddings": [("vec_id", "whole"), ("label", "whole")],
    "pages": [("page_id", "whole"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "whole"), ("text", "string")],
    "labels": [("doc_id", "whole"), ("quality", "whole"), ("toxic", "whole")],
    "conversations": [("conv_id", "whole"), ("turn", "whole"), ("role", "string"), ("text", "string")],
}


@query(
    "keys_inclusions",
    "WITH v AS ("
    + " UNION ALL ".join(
        f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, '{f}' AS f, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL" for t, columns in FAMILIES.items() for c, f in columns
    )
    + """), n AS (SELECT t, c, count(*) AS n_values FROM v GROUP BY ALL),
    s AS (SELECT a.t, a.c, b.t AS other, b.c AS other_c, count(*) AS m FROM v a JOIN v b ON a.f = b.f AND a.v = b.v AND (a.t <> b.t OR a.c <> b.c) GROUP BY ALL)
    SELECT s.t AS from_table, s.c AS from_column, other AS to_table, other_c AS to_column, n_values FROM s JOIN n ON n.t = s.t AND n.c = s.c AND n_values = m
    """,
)
def keys_inclusions(spark, sf_dir):
    """Which columns of the whole estate lie within which others."""
    return keys.inclusions(tables(spark, sf_dir, *FAMILIES))


CATALOG_TABLES = ["region", "nation", "supplier", "customer"]


@query(
    "catalog_names",
    " UNION ALL ".join(f"SELECT 'spark_catalog' AS catalog_name, '{t}' AS table_name, count(*) AS n, true AS schema_listed FROM {t}" for t in CATALOG_TABLES),
)
def catalog_names(spark, sf_dir):
    """Catalogs, schemas and tables found by name, from a schema given as catalog.schema."""
    schema, _ = scratch_schema(spark)
    for name, df in tables(spark, sf_dir, *CATALOG_TABLES).items():
        sinks.full_refresh(df, f"{schema}.{name}")
    home, own = catalog.parse_schema_name(f" spark_catalog.{schema}. ")
    found = None
    for name in catalog.list_tables(spark, f"{home}.{own}") if home in catalog.list_catalogs(spark) else []:
        one = spark.table(f"{home}.{own}.{name}").agg(F.count("*").alias("n")).select(
            F.lit(home).alias("catalog_name"), F.lit(name).alias("table_name"), "n", F.lit(own in catalog.list_schemas(spark, home)).alias("schema_listed")
        )
        found = one if found is None else found.unionByName(one)
    return found


@query(
    "keys_guard",
    """
    SELECT 'together' AS loaded, 'labels' AS from_table, 'doc_id' AS from_column, 'doc' AS to_table, 'high' AS confidence, count(*) AS n FROM labels
    """,
)
def keys_guard(spark, sf_dir):
    """One table alone has no relationships, with the table it refers to it has one."""
    t = tables(spark, sf_dir, "labels", "documents")
    columns = cut(profile.profile_tables({"labels": t["labels"], "doc": t["documents"].select("doc_id", "lang")}))
    alone = keys.resolve(columns.filter("table_name = 'labels'")).withColumn("loaded", F.lit("alone"))
    both = alone.unionByName(keys.resolve(columns).withColumn("loaded", F.lit("together")))
    rows = t["labels"].agg(F.count("*")).scalar()
    return both.select("loaded", "from_table", "from_column", "to_table", "confidence").withColumn("n", rows)


@query("catalog_profile", " UNION ALL ".join(profile_sql(name) for name in CATALOG_TABLES))
def catalog_profile(spark, sf_dir):
    """Tables registered in a catalog schema, found and profiled by name."""
    schema, _ = scratch_schema(spark)
    for name, df in tables(spark, sf_dir, *CATALOG_TABLES).items():
        sinks.full_refresh(df, f"{schema}.{name}")
    _, columns = profile.profile_schema(spark, schema)
    return shown(columns)


@query(
    "catalog_inventory",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, {i} AS ordinal, '{c}' AS name, '{dtype}' AS data_type, 'crm.{t}' AS record_source, "
        f"(SELECT count(*) FROM {t}) AS row_count"
        for t in CATALOG_TABLES
        for i, (c, dtype, _) in enumerate(COLUMNS[t])
    ),
)
def catalog_inventory(spark, sf_dir):
    """Column inventory of a schema with the row counts of its tables."""
    schema, _ = scratch_schema(spark)
    counts = None
    for name, df in tables(spark, sf_dir, *CATALOG_TABLES).items():
        sinks.full_refresh(df, f"{schema}.{name}")
    for name, df in catalog.scan(spark, schema).items():
        one = df.agg(F.count("*").alias("row_count")).withColumn("table_name", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    columns = catalog.inventory(spark, schema, source_prefix="crm")
    return columns.join(counts, "table_name").select(
        "table_name", "ordinal", "name", "data_type", "record_source", "row_count"
    )


@query(
    "scan_formats",
    " UNION ALL ".join(
        f"SELECT '{fmt}' AS format, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, "
        "count(DISTINCT o_orderstatus) AS statuses, CAST(max(o_orderdate) AS VARCHAR) AS last_date FROM orders"
        for fmt in ("parquet", "csv", "json")
    ),
)
def scan_formats(spark, sf_dir):
    """Orders written and read again in each format; json with a given schema, csv inferred."""
    orders = table(spark, sf_dir, "orders")
    out = None
    for fmt in ("parquet", "csv", "json"):
        path = scratch(spark, f"orders-{fmt}")
        if fmt == "parquet":
            orders.write.parquet(path)
        else:
            sinks.write_result(orders, path, fmt)
        df = files.read(spark, path, fmt, schema=orders.schema if fmt == "json" else None)
        one = df.agg(
            F.count("*").alias("n"),
            F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"),
            F.count_distinct("o_orderstatus").alias("statuses"),
            F.max("o_orderdate").cast("timestamp_ntz").cast("string").alias("last_date"),
        ).withColumn("format", F.lit(fmt))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "table_names",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in COLUMNS),
)
def table_names(spark, sf_dir):
    """Rows per table, named by the file they came from."""
    out = None
    for name in COLUMNS:
        one = files.with_table_name(table(spark, sf_dir, name), sf_dir).groupBy("table_name").agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("table_name").agg(F.sum("n").alias("n"))


@query(
    "sample_share",
    """
    SELECT o_orderkey, o_orderstatus FROM orders
    WHERE CAST(('0x' || substr(md5('7:' || CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) < CAST(floor(0.1 * 4294967296) AS BIGINT)
    """,
)
def sample_share(spark, sf_dir):
    """A repeatable tenth of the orders."""
    orders = table(spark, sf_dir, "orders")
    return files.sample_share(orders, F.col("o_orderkey"), 0.1, seed=7).select("o_orderkey", "o_orderstatus")


def part_inventory(spark, sf_dir) -> str:
    """Inventory files, one table object per part; some are faulty."""
    part = table(spark, sf_dir, "part")
    columns = F.array(
        F.struct(
            F.col("p_name").alias("name"),
            F.when(F.col("p_size") != 50, F.lit("DECIMAL(18,2)")).alias("data_type"),
            F.array(*[F.concat("p_brand", F.lit(f"-{i}")) for i in range(7)]).alias("sample_values"),
        ),
        F.struct(F.lit("brand").alias("name"), F.lit("string").alias("data_type"), F.array("p_type").alias("sample_values")),
    )
    edge = F.array(
        F.struct(
            F.lit("brand").alias("from_column"), F.col("p_brand").alias("to_table"),
            F.lit("brand_id").alias("to_column"), F.lit("high").alias("confidence"),
        )
    )
    doc = F.struct(
        F.when(F.col("p_size") != 49, F.concat(F.lit("part_"), F.col("p_partkey").cast("string"))).alias("table_name"),
        F.when(F.col("p_size") != 48, columns).alias("columns"),
        edge.alias("relationships"),
        F.col("p_type").alias("steward"),
    )
    path = scratch(spark, "inventory")
    as_list = F.concat(F.lit("["), F.to_json(doc), F.lit("]"))
    text = F.when(F.col("p_size") == 47, "not json").when(F.col("p_size") > 25, as_list).otherwise(F.to_json(doc))
    part.select(text.alias("value")).write.text(path)
    return path


@query(
    "inventory_columns",
    """
    SELECT 'part_' || p_partkey AS table_name, 0 AS ordinal, p_name AS name, 'decimal(18,2)' AS data_type,
      p_brand || '-0|' || p_brand || '-1|' || p_brand || '-2|' || p_brand || '-3|' || p_brand || '-4|' || p_brand || '-5|' || p_brand || '-6' AS samples, p_type AS steward
    FROM part WHERE p_size NOT IN (47, 48, 49, 50)
    UNION ALL SELECT 'part_' || p_partkey, 1, 'brand', 'string', p_type, p_type FROM part WHERE p_size NOT IN (47, 48, 49, 50)
    """,
)
def inventory_columns(spark, sf_dir):
    good, _ = metadata.read_inventory(spark, part_inventory(spark, sf_dir), lines=True)
    extra = good.select("table_name", F.element_at("extra", "steward").alias("steward"))
    columns = metadata.explode_columns(good).select(
        "table_name", "ordinal", "name", "data_type", F.array_join("sample_values", "|").alias("samples")
    )
    return columns.join(extra, "table_name")


@query(
    "inventory_rejects",
    """
    SELECT CASE p_size WHEN 47 THEN 'not an object or array' WHEN 48 THEN 'missing or empty columns'
      WHEN 49 THEN 'missing table_name' ELSE 'column without name or data_type' END AS reason, count(*) AS n
    FROM part WHERE p_size IN (47, 48, 49, 50) GROUP BY 1
    """,
)
def inventory_rejects(spark, sf_dir):
    _, rejects = metadata.read_inventory(spark, part_inventory(spark, sf_dir), lines=True)
    return rejects.groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "inventory_relationships",
    """
    SELECT 'part_' || p_partkey AS from_table, 'brand' AS from_column, p_brand AS to_table, 'brand_id' AS to_column,
      'high' AS confidence FROM part WHERE p_size NOT IN (47, 48, 49, 50)
    """,
)
def inventory_relationships(spark, sf_dir):
    good, _ = metadata.read_inventory(spark, part_inventory(spark, sf_dir), lines=True)
    return keys.relationships(good)
