"""Vault loads, history, and dimensional tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.hashing import hash_key
from sievework.operators import asof, recon, satlog, vault
from sievework.operators.profile import profile_tables
from sievework.plans import warehouse
from sievework.registered.registry import query, scratch_schema, table, tables
from sievework.session import cut
from sievework.sources import sinks

LOADED = "2024-01-01"
ZERO = "0" * 64


def texts(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as text."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def customer_sources(spark, sf_dir) -> list[vault.Source]:
    t = tables(spark, sf_dir, "customer", "orders")
    return [
        vault.Source(t["customer"], ["c_custkey"], "crm.customer", LOADED),
        vault.Source(t["orders"], ["o_custkey"], "erp.orders", F.col("o_orderdate")),
    ]


HUB_CUSTOMER = f"""
    SELECT sha256(CAST(k AS VARCHAR)) AS customer_hk, k AS c_custkey, CAST(ld AS VARCHAR) AS load_date, rs AS record_source
    FROM (SELECT c_custkey AS k, TIMESTAMP '{LOADED}' AS ld, 'crm.customer' AS rs FROM customer
      UNION ALL SELECT o_custkey, o_orderdate, 'erp.orders' FROM orders)
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY ld, rs) = 1
"""


@query("vault_hub_customer", HUB_CUSTOMER + f" UNION ALL SELECT '{ZERO}', NULL, '1900-01-01 00:00:00', 'GHOST'")
def vault_hub_customer(spark, sf_dir):
    return texts(vault.hub("customer", customer_sources(spark, sf_dir), ["c_custkey"]), "load_date")


@query(
    "vault_hub_incremental",
    """
    SELECT sha256(CAST(c_custkey AS VARCHAR)) AS customer_hk, c_custkey, '2024-02-01 00:00:00' AS load_date, 'crm.customer' AS record_source
    FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
    """,
)
def vault_hub_incremental(spark, sf_dir):
    """Keys a hub lacks: it was loaded from finished orders, now all customers arrive."""
    t = tables(spark, sf_dir, "customer", "orders")
    finished = vault.Source(t["orders"].filter("o_orderstatus = 'F'"), ["o_custkey"], "erp.orders", LOADED)
    known = vault.hub("customer", [finished], ["c_custkey"])
    arriving = vault.Source(t["customer"], ["c_custkey"], "crm.customer", "2024-02-01")
    return texts(vault.hub("customer", [arriving], ["c_custkey"], existing=known), "load_date")


@query(
    "vault_hub_md5",
    "SELECT md5(upper(trim(p_brand)) || '|' || upper(trim(p_type))) AS product_hk, p_brand, p_type, '2024-01-01 00:00:00' AS load_date, "
    "'erp.part' AS record_source FROM (SELECT DISTINCT p_brand, p_type FROM part)",
)
def vault_hub_md5(spark, sf_dir):
    """Composite business key, MD5."""
    source = vault.Source(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "erp.part", LOADED)
    return texts(vault.hub("product", [source], ["p_brand", "p_type"], with_ghost=False, algo="md5"), "load_date")


@query(
    "vault_link_order_customer",
    f"""
    SELECT sha256(upper(order_hk) || '|' || upper(customer_hk)) AS order_customer_hk, order_hk, customer_hk,
      '2024-01-01 00:00:00' AS load_date, 'erp.orders' AS record_source
    FROM (SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS order_hk,
      CASE WHEN o_custkey = 7 THEN '{ZERO}' ELSE sha256(CAST(o_custkey AS VARCHAR)) END AS customer_hk FROM orders)
    """,
)
def vault_link_order_customer(spark, sf_dir):
    """Orders linked to customers; orders of customer 7 have lost it and point at the ghost."""
    orders = table(spark, sf_dir, "orders").withColumn("o_custkey", F.nullif("o_custkey", F.lit(7)))
    source = vault.Source(orders, ["o_orderkey", "o_custkey"], "erp.orders", LOADED)
    out = vault.link("order_customer", [source], {"order": ["o_orderkey"], "customer": ["c_custkey"]})
    return texts(out, "load_date")


def user_days(spark, sf_dir, events: DataFrame | None = None) -> DataFrame:
    """Staged: the last event type of each user and day."""
    events = table(spark, sf_dir, "events") if events is None else events
    return vault.stage(
        events, "user_hk", ["user_id"], F.date_trunc("day", "ts"), ["event_type"], "web.events", ["ts", "event_id"]
    )


def sat_sql(day: str) -> str:
    return f"""
      SELECT sha256(CAST(user_id AS VARCHAR)) AS user_hk, CAST(d AS VARCHAR) AS load_date,
        CAST(lead(d) OVER (PARTITION BY user_id ORDER BY d) AS VARCHAR) AS load_end_date, 'web.events' AS record_source,
        sha256(event_type) AS hash_diff, event_type
      FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY d) AS before
        FROM (SELECT user_id, {day} AS d, event_type FROM events
          QUALIFY row_number() OVER (PARTITION BY user_id, {day} ORDER BY ts DESC, event_id DESC) = 1))
      WHERE before IS NULL OR before <> event_type"""


SAT_USER = sat_sql("date_trunc('day', ts)::TIMESTAMP")


def sat_user(spark, sf_dir) -> DataFrame:
    return vault.satellite(
        table(spark, sf_dir, "events"), "user_hk", ["user_id"], F.date_trunc("day", "ts"), ["event_type"], "web.events",
        ["ts", "event_id"], chunk=None,  # at most one row per day
    )


@query("vault_sat_user", SAT_USER)
def vault_sat_user(spark, sf_dir):
    return texts(sat_user(spark, sf_dir), "load_date", "load_end_date")


@query("vault_sat_user_events", sat_sql("ts"))
def vault_sat_user_events(spark, sf_dir):
    """History at full time resolution; long histories are cut by day."""
    events = table(spark, sf_dir, "events")
    sat = vault.satellite(
        events, "user_hk", ["user_id"], F.col("ts"), ["event_type"], "web.events", ["ts", "event_id"], chunk="day"
    )
    return texts(sat, "load_date", "load_end_date")


@query("vault_sat_merge", SAT_USER)
def vault_sat_merge(spark, sf_dir):
    """Two loads, the second repeating a day of the first, give the history of one load."""
    events = table(spark, sf_dir, "events")
    schema, _ = scratch_schema(spark)
    first = vault.history(user_days(spark, sf_dir, events.filter("ts < '2024-01-15'")), "user_hk", chunk=None)
    sinks.full_refresh(first, f"{schema}.sat_user")
    second = cut(user_days(spark, sf_dir, events.filter("ts >= '2024-01-14'")))
    merged = vault.merge_history(spark.table(f"{schema}.sat_user"), second, "user_hk", chunk=None)
    return texts(merged, "load_date", "load_end_date")


def log_of(spark, loads: list[DataFrame], day, chunk: str) -> DataFrame:
    """A stored log after some loads of events."""
    schema, _ = scratch_schema(spark)
    target = f"{schema}.sat_log"
    for rows in loads:
        satlog.load(satlog.observe(rows, "user_hk", ["user_id"], day, ["event_type"], "web.events", ["ts", "event_id"], chunk), target, "user_hk", 16)
    return spark.table(target)


@query("vault_sat_any_order", SAT_USER)
def vault_sat_any_order(spark, sf_dir):
    """Three loads, each with a third of the events of every day, one of them twice: the history of one load."""
    events = table(spark, sf_dir, "events")
    thirds = [events.filter(f"pmod(event_id, 3) = {i}") for i in (2, 0, 1, 2)]
    log = log_of(spark, thirds, F.date_trunc("day", "ts"), "month")
    return texts(satlog.satellite(log, "user_hk", chunk=None), "load_date", "load_end_date")


@query("vault_sat_events_any_order", sat_sql("ts"))
def vault_sat_events_any_order(spark, sf_dir):
    """History at full time resolution, the last weeks loaded first."""
    events = table(spark, sf_dir, "events")
    newest = events.agg(F.max("ts") - F.expr("INTERVAL 14 DAYS")).scalar()
    parts = events.withColumn("_late", F.col("ts") > newest)
    log = log_of(spark, [parts.filter("_late"), parts.filter("not _late and event_id % 2 = 0"), parts.filter("not _late and event_id % 2 = 1")], F.col("ts"), "day")
    return texts(satlog.satellite(log, "user_hk", chunk="day"), "load_date", "load_end_date")


@query(
    "vault_sat_split",
    """
    SELECT satellite, count(*) AS n, count(*) FILTER (e IS NULL) AS open FROM (
      SELECT satellite, lead(d) OVER (PARTITION BY satellite, user_id ORDER BY d) AS e FROM (
        SELECT *, lag(v) OVER (PARTITION BY satellite, user_id ORDER BY d) AS before FROM (
          SELECT 'SAT_USER_TYPE' AS satellite, user_id, date_trunc('day', ts) AS d, event_type AS v FROM events
            QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts DESC, event_id DESC) = 1
          UNION ALL SELECT 'SAT_USER_PROPS', user_id, date_trunc('day', ts), props FROM events
            QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts DESC, event_id DESC) = 1))
      WHERE before IS NULL OR before <> v)
    GROUP BY 1
    """,
)
def vault_sat_split(spark, sf_dir):
    """Slow and fast attributes in satellites of their own."""
    staged = vault.stage(
        table(spark, sf_dir, "events"), "user_hk", ["user_id"], F.date_trunc("day", "ts"), ["event_type", "props"],
        "web.events", ["ts", "event_id"],
    )
    groups = {
        vault.entity_name("satellite", "user", "type"): ["event_type"],
        vault.entity_name("satellite", "user", "props"): ["props"],
    }
    out = None
    for name, sat in vault.split(staged, "user_hk", groups, chunk=None).items():
        one = sat.agg(F.count("*").alias("n"), F.count_if(F.col("load_end_date").isNull()).alias("open"))
        one = one.withColumn("satellite", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "vault_change_rates",
    """
    SELECT 'event_type' AS attribute, count(*) AS steps, count(*) FILTER (event_type <> b) AS changes,
      round_even(count(*) FILTER (event_type <> b) / count(*), 4) AS change_rate
    FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY d) AS b FROM (
      SELECT user_id, date_trunc('day', ts) AS d, event_type FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts DESC, event_id DESC) = 1))
    WHERE b IS NOT NULL
    """,
)
def vault_change_rates(spark, sf_dir):
    return vault.change_rates(user_days(spark, sf_dir), "user_hk", ["event_type"])


@query(
    "vault_link_sat",
    """
    SELECT sha256(upper(sha256(CAST(l_orderkey AS VARCHAR))) || '|' || upper(sha256(CAST(l_partkey AS VARCHAR)))) AS order_part_hk,
      l_returnflag, l_linestatus
    FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey
      ORDER BY l_shipdate DESC, l_linenumber DESC, l_returnflag DESC, l_linestatus DESC) = 1
    """,
)
def vault_link_sat(spark, sf_dir):
    """Descriptive data of the order-part link."""
    lines = table(spark, sf_dir, "lineitem")
    parent = hash_key(hash_key(F.col("l_orderkey")), hash_key(F.col("l_partkey")))
    sat = vault.satellite(
        lines, "order_part_hk", ["l_orderkey", "l_partkey"], F.lit(LOADED), ["l_returnflag", "l_linestatus"],
        "erp.lineitem", ["l_shipdate", "l_linenumber", "l_returnflag", "l_linestatus"],
        chunk=None, parent_key=parent,  # one load date
    )
    return sat.select("order_part_hk", "l_returnflag", "l_linestatus")


@query(
    "vault_pit_daily",
    f"""
    WITH sat AS ({SAT_USER}), snaps AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS s)
    SELECT user_hk, CAST(s AS VARCHAR) AS snapshot_date, load_date AS sat_user_load_date FROM sat JOIN snaps
    ON s >= CAST(load_date AS TIMESTAMP) AND (load_end_date IS NULL OR s < CAST(load_end_date AS TIMESTAMP))
    """,
)
def vault_pit_daily(spark, sf_dir):
    pit = vault.point_in_time({"sat_user": sat_user(spark, sf_dir)}, "user_hk", "2024-01-01", "2024-01-30")
    return texts(pit, "snapshot_date", "sat_user_load_date")


@query(
    "vault_pit_two_satellites",
    """
    WITH days AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS d, event_type, props FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts DESC, event_id DESC) = 1),
      snaps AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-07', TIMESTAMP '2024-01-30', INTERVAL 7 DAY)) AS s),
      a AS (SELECT user_id, d FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY d) AS b FROM days) WHERE b IS NULL OR b <> event_type),
      p AS (SELECT user_id, d FROM (SELECT *, lag(props) OVER (PARTITION BY user_id ORDER BY d) AS b FROM days) WHERE b IS NULL OR b <> props)
    SELECT sha256(CAST(user_id AS VARCHAR)) AS user_hk, CAST(s AS VARCHAR) AS snapshot_date,
      CAST((SELECT max(d) FROM a WHERE a.user_id = u.user_id AND d <= s) AS VARCHAR) AS type_load_date,
      CAST((SELECT max(d) FROM p WHERE p.user_id = u.user_id AND d <= s) AS VARCHAR) AS props_load_date
    FROM (SELECT user_id, min(d) AS first FROM days GROUP BY 1) u JOIN snaps ON s >= first
    """,
)
def vault_pit_two_satellites(spark, sf_dir):
    staged = vault.stage(
        table(spark, sf_dir, "events"), "user_hk", ["user_id"], F.date_trunc("day", "ts"), ["event_type", "props"],
        "web.events", ["ts", "event_id"],
    )
    sats = vault.split(staged, "user_hk", {"type": ["event_type"], "props": ["props"]}, chunk=None)
    pit = vault.point_in_time(sats, "user_hk", "2024-01-07", "2024-01-30", every_days=7)
    return texts(pit, "snapshot_date", "type_load_date", "props_load_date")


@query(
    "vault_bridge_part_supplier",
    """
    SELECT sha256(upper(sha256(CAST(l_partkey AS VARCHAR))) || '|' || upper(sha256(CAST(l_suppkey AS VARCHAR)))) AS part_supplier_hk,
      l_partkey AS p_partkey, l_suppkey AS s_suppkey
    FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
    WHERE l_partkey IN (SELECT p_partkey FROM part) AND l_suppkey IN (SELECT s_suppkey FROM supplier)
    """,
)
def vault_bridge_part_supplier(spark, sf_dir):
    t = tables(spark, sf_dir, "lineitem", "part", "supplier")
    links = vault.link(
        "part_supplier",
        [vault.Source(t["lineitem"], ["l_partkey", "l_suppkey"], "erp.lineitem", LOADED)],
        {"part": ["p_partkey"], "supplier": ["s_suppkey"]},
    )
    hubs = {
        "part": vault.hub("part", [vault.Source(t["part"], ["p_partkey"], "erp.part", LOADED)], ["p_partkey"]),
        "supplier": vault.hub("supplier", [vault.Source(t["supplier"], ["s_suppkey"], "erp.supplier", LOADED)], ["s_suppkey"]),
    }
    return vault.bridge(links, hubs, "part_supplier").select("part_supplier_hk", "p_partkey", "s_suppkey")


MEASURES = {
    "quantity": "sum(quantity)",
    "revenue": "sum(revenue)",
}


def order_lines(spark, sf_dir) -> DataFrame:
    """Line items summed per order and flag, with the customer of the order."""
    t = tables(spark, sf_dir, "lineitem", "orders")
    price = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    lines = t["lineitem"].groupBy("l_orderkey", "l_returnflag").agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("quantity"), F.sum(price).alias("revenue")
    )
    orders = t["orders"].select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


FACT = """
    SELECT sha256(CAST(o_custkey AS VARCHAR)) AS customer_hk{flag},
      CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey{flag}
"""


def as_doubles(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in MEASURES})


@query("fact_sales", FACT.format(flag=", l_returnflag"))
def fact_sales(spark, sf_dir):
    return as_doubles(vault.fact(order_lines(spark, sf_dir), {"customer": ["o_custkey"]}, MEASURES, ["l_returnflag"]))


DIM_CUSTOMER = f"""
    SELECT sha256(CAST(c_custkey AS VARCHAR)) AS customer_hk, c_custkey, c_name, c_nationkey, c_mktsegment FROM customer
    UNION ALL SELECT '{ZERO}', NULL, NULL, NULL, NULL
"""


def silver(spark, sf_dir) -> dict[str, DataFrame]:
    return warehouse.build("silver", tables(spark, sf_dir, "customer", "orders", "lineitem"), LOADED)


@query("dim_customer", DIM_CUSTOMER)
def dim_customer(spark, sf_dir):
    return warehouse.build("gold", silver(spark, sf_dir), order_lines(spark, sf_dir), MEASURES)["DIM_CUSTOMER"]


@query("fact_sales_by_customer", FACT.format(flag=""))
def fact_sales_by_customer(spark, sf_dir):
    return as_doubles(
        warehouse.build("gold", silver(spark, sf_dir), order_lines(spark, sf_dir), MEASURES)["FACT_SALES"]
    )


@query(
    "vault_layers",
    """
    SELECT 'HUB_CUSTOMER' AS entity, count(DISTINCT o_custkey) AS n, 0 AS missing FROM (SELECT o_custkey FROM orders UNION ALL SELECT c_custkey FROM customer UNION ALL SELECT -1)
    UNION ALL SELECT 'HUB_ORDER', count(DISTINCT o_orderkey), 0 FROM (SELECT o_orderkey FROM orders UNION ALL SELECT l_orderkey FROM lineitem UNION ALL SELECT -1)
    UNION ALL SELECT 'LNK_ORDER_CUSTOMER', count(*), 0 FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders)
    UNION ALL SELECT 'SAT_CUSTOMER_DETAILS', count(DISTINCT c_custkey), 0 FROM customer
    """,
)
def vault_layers(spark, sf_dir):
    """Rows of each silver entity, and mandatory columns it lacks."""
    kinds = {
        "HUB_CUSTOMER": ("hub", "customer", ["c_custkey"]),
        "HUB_ORDER": ("hub", "order", ["o_orderkey"]),
        "LNK_ORDER_CUSTOMER": ("link", "order_customer", ["order_hk", "customer_hk"]),
        "SAT_CUSTOMER_DETAILS": ("satellite", "customer", []),
    }
    out = None
    for name, df in silver(spark, sf_dir).items():
        missing = len(vault.missing_columns(df, *kinds[name]))
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n", F.lit(missing).alias("missing"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "vault_computed_sat",
    """
    SELECT sha256(CAST(c_custkey AS VARCHAR)) AS customer_hk, sha256(band || '|' || CAST(in_debt AS VARCHAR)) AS hash_diff, band, in_debt
    FROM (SELECT c_custkey, CASE WHEN c_acctbal >= 5000 THEN 'high' ELSE 'low' END AS band, c_acctbal < 0 AS in_debt FROM customer)
    """,
)
def vault_computed_sat(spark, sf_dir):
    """Derived attributes under business rules."""
    rows = table(spark, sf_dir, "customer").withColumns(
        {"band": F.when(F.col("c_acctbal") >= 5000, "high").otherwise("low"), "in_debt": F.col("c_acctbal") < 0}
    )
    sat = vault.satellite(
        rows, "customer_hk", ["c_custkey"], F.lit(LOADED), ["band", "in_debt"], "rules.customer", ["band"],
        chunk=None,  # one load date
    )
    return sat.select("customer_hk", "hash_diff", "band", "in_debt")


SPELLED = """
    (SELECT CASE WHEN p_size = 50 THEN NULL WHEN p_size % 3 = 0 THEN lower(p_brand) WHEN p_size % 3 = 1 THEN '  ' || p_brand || ' ' ELSE upper(p_brand) END AS brand,
      CASE WHEN p_size = 50 THEN NULL WHEN p_size % 2 = 0 THEN 'a|b' ELSE 'N/A' END AS kind, p_size, p_retailprice FROM part)
"""


@query(
    "vault_spellings",
    f"""
    WITH keys AS (SELECT DISTINCT upper(trim(brand)) AS b, kind AS k FROM {SPELLED} WHERE brand IS NOT NULL),
      ghost AS (SELECT CAST(max(CASE WHEN brand IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS g FROM {SPELLED})
    SELECT 'hub' AS part_of, count(*) AS n, count(*) AS hash_keys FROM keys
    UNION ALL SELECT 'satellite', count(*), count(*) FROM keys
    UNION ALL SELECT 'stage', count(*), count(*) FROM keys
    UNION ALL SELECT 'dimension', count(*), count(*) FROM keys
    UNION ALL SELECT 'point_in_time', count(*), count(*) FROM keys
    UNION ALL SELECT 'fact', count(*) + max(g), count(*) + max(g) FROM keys, ghost
    """,
)
def vault_spellings(spark, sf_dir):
    """Mixed case, blanks, separators and NULLs in text keys: every structure holds one row per hash key."""
    size, brand = F.col("p_size"), F.col("p_brand")
    spelled = F.when(size % 3 == 0, F.lower(brand)).when(size % 3 == 1, F.concat(F.lit("  "), brand, F.lit(" "))).otherwise(F.upper(brand))
    part = table(spark, sf_dir, "part").select(
        F.when(size != 50, spelled).alias("brand"), F.when(size == 50, None).when(size % 2 == 0, "a|b").otherwise("N/A").alias("kind"),
        "p_size", "p_retailprice",
    )
    keys, loaded = ["brand", "kind"], F.lit(LOADED)
    hub = vault.hub("part", [vault.Source(part, keys, "erp.part", LOADED)], keys, with_ghost=False)
    sat = vault.satellite(part, "part_hk", keys, loaded, ["p_size"], "erp.part", ["p_size"], chunk=None)
    found = {
        "hub": hub,
        "satellite": sat.filter(vault.CURRENT),
        "stage": vault.stage(part, "part_hk", keys, loaded, ["p_size"], "erp.part", ["p_size"]),
        "dimension": vault.dimension(hub, [sat], "part_hk"),
        "point_in_time": vault.point_in_time({"sat": sat}, "part_hk", "2024-02-01", "2024-02-01"),
        "fact": vault.fact(part, {"part": keys}, {"n": "count(*)"}),
    }
    out = None
    for name, df in found.items():
        one = df.agg(F.lit(name).alias("part_of"), F.count("*").alias("n"), F.count_distinct("part_hk").alias("hash_keys"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "vault_hub_candidates",
    """
    SELECT * FROM (
      SELECT 'orders' AS table_name, 'order_key' AS name, count(DISTINCT o_orderkey) AS distinct_count FROM orders
      UNION ALL SELECT 'orders', 'customer_key', count(DISTINCT o_custkey) FROM orders
      UNION ALL SELECT 'orders', 'status_code', count(DISTINCT o_orderstatus) FROM orders
      UNION ALL SELECT 'customer', 'customer_key', count(DISTINCT c_custkey) FROM customer
      UNION ALL SELECT 'customer', 'nation_key', count(DISTINCT c_nationkey) FROM customer)
    WHERE distinct_count >= 100
    """,
)
def vault_hub_candidates(spark, sf_dir):
    t = tables(spark, sf_dir, "orders", "customer")
    columns = profile_tables(
        {
            "orders": t["orders"].selectExpr(
                "o_orderkey AS order_key", "o_custkey AS customer_key", "o_orderstatus AS status_code", "o_orderdate AS date_key"
            ),
            "customer": t["customer"].selectExpr("c_custkey AS customer_key", "c_nationkey AS nation_key", "c_name AS name"),
        }
    )
    return vault.hub_candidates(columns, min_distinct=100).select("table_name", "name", "distinct_count")


@query("vault_coverage", "SELECT count(*) AS source_rows, CAST(0 AS BIGINT) AS differing_rows, CAST('c_acctbal' AS VARCHAR) AS uncovered FROM customer")
def vault_coverage(spark, sf_dir):
    """The source rebuilt from hub and satellite, and the column they leave out."""
    customer = table(spark, sf_dir, "customer")
    vaults = silver(spark, sf_dir)
    hub_df, sat = vaults["HUB_CUSTOMER"], vaults["SAT_CUSTOMER_DETAILS"]
    held = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    rebuilt = sat.join(hub_df.select("customer_hk", "c_custkey"), "customer_hk").select(*held)
    differing = recon.row_difference(customer.select(*held), rebuilt).agg(F.count("*").alias("n"))
    uncovered = ",".join(vault.uncovered_columns(customer.schema, [hub_df, sat]))
    return customer.agg(F.count("*").alias("source_rows")).select(
        "source_rows", differing.scalar().alias("differing_rows"), F.lit(uncovered).alias("uncovered")
    )


@query(
    "vault_faults",
    """
    SELECT 'rows the satellite lacks' AS fault, count(*) AS n, 'c_acctbal' AS named FROM customer WHERE c_custkey % 8 = 1
    UNION ALL SELECT 'columns the satellite lacks', (SELECT count(*) FROM customer), 'hash_diff,load_end_date'
    UNION ALL SELECT 'source columns without a place', (SELECT count(*) FROM customer), 'c_name,c_acctbal'
    """,
)
def vault_faults(spark, sf_dir):
    """Coverage and mandatory columns on a vault that has lost rows and columns."""
    customer = table(spark, sf_dir, "customer")
    vaults = silver(spark, sf_dir)
    hub_df, sat = vaults["HUB_CUSTOMER"], vaults["SAT_CUSTOMER_DETAILS"]
    keyed = sat.join(hub_df.select("customer_hk", "c_custkey"), "customer_hk").select("c_custkey", "c_name")
    lost = recon.row_difference(customer.select("c_custkey", "c_name"), keyed.filter("c_custkey % 8 <> 1")).filter("copies > 0").agg(F.count("*").alias("n"))
    rows = customer.agg(F.count("*").alias("n"))

    def found(fault: str, n: DataFrame, named: list[str]) -> DataFrame:
        return n.select(F.lit(fault).alias("fault"), "n", F.lit(",".join(named)).alias("named"))

    bare = sat.drop("hash_diff", "load_end_date")
    return (
        found("rows the satellite lacks", lost, vault.uncovered_columns(customer.schema, [hub_df, sat]))
        .unionByName(found("columns the satellite lacks", rows, sorted(vault.missing_columns(bare, "satellite", "customer", []))))
        .unionByName(found("source columns without a place", rows, vault.uncovered_columns(customer.schema, [hub_df, sat.drop("c_name")])))
    )


@query(
    "vault_as_of",
    f"""
    WITH types AS ({SAT_USER}),
    bands AS (
      SELECT user_id, ts AS load_date, band FROM (
        SELECT *, lag(band) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM (
          SELECT user_id, ts, CAST(floor(value / 25) AS BIGINT) AS band FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1))
      WHERE before IS NULL OR before <> band
    ), asked AS (SELECT event_id, user_id, sha256(CAST(user_id AS VARCHAR)) AS user_hk, ts - INTERVAL 3 DAY AS at FROM events)
    SELECT a.event_id, t.event_type AS day_event_type, b.band AS band_band
    FROM asked a ASOF LEFT JOIN (SELECT user_hk, CAST(load_date AS TIMESTAMP) AS load_date, event_type FROM types) t ON a.user_hk = t.user_hk AND a.at >= t.load_date
    ASOF LEFT JOIN bands b ON a.user_id = b.user_id AND a.at >= b.load_date
    """,
)
def vault_as_of(spark, sf_dir):
    """Each event with what two satellites of its user held three days before it."""
    events = table(spark, sf_dir, "events")
    banded = events.withColumn("band", F.floor(F.col("value") / 25))
    bands = vault.satellite(banded, "user_hk", ["user_id"], F.col("ts"), ["band"], "web.events", ["ts", "event_id"], chunk="day")
    asked = events.select("event_id", hash_key(F.col("user_id")).alias("user_hk"), (F.col("ts") - F.expr("INTERVAL 3 DAYS")).alias("at"))
    found = asof.as_of(
        asked, {"day": sat_user(spark, sf_dir), "band": bands}, ["user_hk"], "at", {"day": ["event_type"], "band": ["band"]}, unit="week"
    )
    return found.select("event_id", "day_event_type", "band_band")
