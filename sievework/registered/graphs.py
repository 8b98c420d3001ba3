"""Lineage over edge tables, and synthetic rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators import lineage, profile, reach, synth
from sievework.operators.synth import ColumnSpec
from sievework.registered.registry import query, table, tables


def supply_chain(spark, sf_dir) -> DataFrame:
    """Mapping rows part -> supplier -> nation -> region; the last step's rule is unknown."""
    t = tables(spark, sf_dir, "lineitem", "supplier", "nation")

    def named(label: str, c: str):
        return F.concat(F.lit(f"{label} "), F.col(c).cast("string"))

    supplied = t["lineitem"].select(
        named("Part", "l_partkey").alias("source"), named("Supplier", "l_suppkey").alias("target"),
        F.lit("supplied by").alias("rule"),
    )
    located = t["supplier"].select(
        named("Supplier", "s_suppkey").alias("source"), named("Nation", "s_nationkey").alias("target"),
        F.lit("located in").alias("rule"),
    )
    within = t["nation"].select(
        named("Nation", "n_nationkey").alias("source"), named("Region", "n_regionkey").alias("target"),
        F.lit("unknown").alias("rule"),
    )
    return supplied.unionByName(located).unionByName(within)


EDGES = """
    SELECT DISTINCT 'part_' || l_partkey AS from_id, 'supplier_' || l_suppkey AS to_id, 'supplied by' AS transformation FROM lineitem
    UNION ALL SELECT 'supplier_' || s_suppkey, 'nation_' || s_nationkey, 'located in' FROM supplier
    UNION ALL SELECT 'nation_' || n_nationkey, 'region_' || n_regionkey, 'passthrough' FROM nation
"""


@query("lineage_edges", EDGES)
def lineage_edges(spark, sf_dir):
    return lineage.edges(supply_chain(spark, sf_dir)).select("from_id", "to_id", "transformation")


@query(
    "lineage_nodes",
    f"""
    SELECT id, upper(id[1]) || replace(id[2:], '_', ' ') AS label, 'bronze' AS layer
    FROM (SELECT from_id AS id FROM ({EDGES}) UNION SELECT to_id FROM ({EDGES}))
    """,
)
def lineage_nodes(spark, sf_dir):
    mappings = supply_chain(spark, sf_dir)
    return lineage.nodes(lineage.edges(mappings), mappings.count())


@query(
    "lineage_downstream",
    """
    SELECT 'supplier_' || s_suppkey AS root, 'nation_' || s_nationkey AS node, 1 AS depth FROM supplier
    UNION ALL SELECT 'supplier_' || s_suppkey, 'region_' || n_regionkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey
    """,
)
def lineage_downstream(spark, sf_dir):
    """What every supplier flows into."""
    edges = lineage.edges(supply_chain(spark, sf_dir))
    roots = edges.filter(F.col("from_id").startswith("supplier_")).select(F.col("from_id").alias("id"))
    return lineage.closure(edges, roots)


@query(
    "lineage_upstream",
    """
    SELECT 'region_' || n_regionkey AS root, 'nation_' || n_nationkey AS node, 1 AS depth FROM nation
    UNION ALL SELECT 'region_' || n_regionkey, 'supplier_' || s_suppkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT DISTINCT 'region_' || n_regionkey, 'part_' || l_partkey, 3
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    """,
)
def lineage_upstream(spark, sf_dir):
    """Everything that reaches each region."""
    edges = lineage.edges(supply_chain(spark, sf_dir))
    roots = edges.filter(F.col("to_id").startswith("region_")).select(F.col("to_id").alias("id"))
    return lineage.closure(edges, roots, downstream=False)


@query(
    "lineage_distances",
    f"""
    WITH RECURSIVE e AS (SELECT from_id, to_id FROM ({EDGES})),
    r AS (SELECT from_id, to_id, 1 AS distance FROM e UNION SELECT r.from_id, e.to_id, distance + 1 FROM r JOIN e ON r.to_id = e.from_id),
    asked AS (
      SELECT DISTINCT 'part_' || l_partkey AS from_id, 'nation_' || (l_partkey % 25) AS to_id FROM lineitem
      UNION ALL SELECT 'supplier_' || s_suppkey, 'region_' || (s_suppkey % 5) FROM supplier
      UNION ALL SELECT 'region_' || r_regionkey, 'nation_' || r_regionkey FROM region
    )
    SELECT from_id, to_id, min(distance) AS distance FROM asked LEFT JOIN r USING (from_id, to_id) GROUP BY ALL
    """,
)
def lineage_distances(spark, sf_dir):
    """Does a part depend on a nation, a supplier on a region, and how far: from a label index, without a closure."""
    t = tables(spark, sf_dir, "lineitem", "supplier", "region")

    def node(label: str, number):
        return F.concat(F.lit(f"{label}_"), number.cast("string"))

    part, supplier, region = F.col("l_partkey"), F.col("s_suppkey"), F.col("r_regionkey")
    asked = (
        t["lineitem"].select(node("part", part).alias("from_id"), node("nation", F.pmod(part, F.lit(25))).alias("to_id")).distinct()
        .unionByName(t["supplier"].select(node("supplier", supplier).alias("from_id"), node("region", F.pmod(supplier, F.lit(5))).alias("to_id")))
        .unionByName(t["region"].select(node("region", region).alias("from_id"), node("nation", region).alias("to_id")))
    )
    return reach.distances(asked, reach.label_index(lineage.edges(supply_chain(spark, sf_dir))))


@query(
    "lineage_cycles",
    """
    WITH home AS (SELECT min(r_regionkey) AS r FROM region)
    SELECT 'nation_' || n_nationkey AS from_id, 'region_' || n_regionkey AS to_id FROM nation, home WHERE n_regionkey = r
    UNION ALL SELECT 'region_' || n_regionkey, 'nation_' || n_nationkey FROM nation, home WHERE n_regionkey = r
    """,
)
def lineage_cycles(spark, sf_dir):
    """The supply chain with one region feeding its nations again."""
    t = tables(spark, sf_dir, "nation", "region")
    first = t["region"].agg(F.min("r_regionkey").alias("r")).scalar()
    back = t["nation"].filter(F.col("n_regionkey") == first).select(
        F.concat(F.lit("Region "), F.col("n_regionkey").cast("string")).alias("source"),
        F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")).alias("target"),
        F.lit("feedback").alias("rule"),
    )
    return lineage.cyclic_edges(lineage.edges(supply_chain(spark, sf_dir).unionByName(back)))


@query("lineage_acyclic", "SELECT CAST(0 AS BIGINT) AS cyclic_edges")
def lineage_acyclic(spark, sf_dir):
    found = lineage.cyclic_edges(lineage.edges(supply_chain(spark, sf_dir)))
    return found.agg(F.count("*").alias("cyclic_edges"))


@query(
    "lineage_layer_jumps",
    """
    SELECT 'orders_' || s_suppkey AS from_id, 'dim_supplier_' || s_suppkey AS to_id, 2 AS step FROM supplier WHERE s_acctbal < 5000
    """,
)
def lineage_layer_jumps(spark, sf_dir):
    """Source to report per supplier; those with a low balance skip the vault."""
    supplier = table(spark, sf_dir, "supplier")
    low = F.col("s_acctbal") < 5000

    def step(a: str, b: str):
        return F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))

    steps = F.array_compact(
        F.array(
            step("src_erp_", "orders_"),
            step("orders_", "hub_supplier_"),
            step("hub_supplier_", "dim_supplier_"),
            step("dim_supplier_", "report_"),
            F.when(low, step("orders_", "dim_supplier_")),
        )
    )
    rows = supplier.select("s_suppkey", F.explode(steps).alias("s")).select(
        F.concat("s.a", F.col("s_suppkey").cast("string")).alias("source"),
        F.concat("s.b", F.col("s_suppkey").cast("string")).alias("target"),
        F.lit("load").alias("rule"),
    )
    return lineage.layer_jumps(lineage.edges(rows)).select("from_id", "to_id", "step")


# -- synthetic rows: one per customer, numbered by its key ---------------------------------------

SEED = 11
NAME = "client"


def draw_sql(column: str, salt: int = 0) -> str:
    return f"CAST('0x' || substr(md5('{SEED}:{NAME}:{column}:{salt}:' || CAST(r AS VARCHAR)), 1, 8) AS BIGINT)"


def pick_sql(values: list[str], number: str) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[CAST({number} % {len(values)} + 1 AS BIGINT)]"


def int_sql(low: int, high: int, number: str) -> str:
    return f"({number} % {high - low + 1} + {low})"


def scaled_sql(low: int, high: int, places: int, number: str) -> str:
    unit = 10**places
    return f"(CAST({number} % {(high - low) * unit + 1} + {low * unit} AS DOUBLE) / {unit}.0::DOUBLE)"


def optional_sql(column: str, value: str) -> str:
    return f"CASE WHEN {draw_sql(column, 9)} >= {int(synth.NULL_SHARE * 2**32)} THEN {value} END"


def _n(column: str) -> str:
    return draw_sql(column)


SYNTH_SQL = {
    "client_id": "r + 1001",
    "full_name": pick_sql(synth.FIRST_NAMES, _n("full_name")) + " || ' ' || " + pick_sql(synth.LAST_NAMES, draw_sql("full_name", 1)),
    "email": optional_sql(
        "email",
        f"lower({pick_sql(synth.FIRST_NAMES, _n('email'))}) || '.' || lower({pick_sql(synth.LAST_NAMES, draw_sql('email', 1))}) "
        f"|| '@' || {pick_sql(synth.DOMAINS, draw_sql('email', 2))}",
    ),
    "phone": optional_sql("phone", f"'+44' || CAST({int_sql(7_000_000_000, 7_999_999_999, _n('phone'))} AS VARCHAR)"),
    "country_code": pick_sql(synth.COUNTRY_CODES, _n("country_code")),
    "country": pick_sql(synth.COUNTRIES, _n("country")),
    "continent": pick_sql(synth.CONTINENTS, _n("continent")),
    "city": pick_sql(synth.CITIES, _n("city")),
    "booking_status": pick_sql(synth.STATUSES, _n("booking_status")),
    "payment_method": pick_sql(synth.PAYMENT_METHODS, _n("payment_method")),
    "property_type": pick_sql(synth.PROPERTY_TYPES, _n("property_type")),
    "user_type": pick_sql(synth.USER_TYPES, _n("user_type")),
    "role": pick_sql(synth.ROLES, _n("role")),
    "device": pick_sql(synth.DEVICES, _n("device")),
    "image_url": f"'https://example.com/property/' || CAST(r + 1001 AS VARCHAR) || '/image_' || CAST({int_sql(1, 5, _n('image_url'))} AS VARCHAR) || '.jpg'",
    "latitude": scaled_sql(-60, 70, 6, _n("latitude")),
    "longitude": scaled_sql(-180, 180, 6, _n("longitude")),
    "rating": scaled_sql(1, 5, 1, _n("rating")),
    "amount": scaled_sql(50, 5000, 2, _n("amount")),
    "guests": int_sql(1, 10, _n("guests")),
    "sort_order": "r + 1",
    "comment": "'Sample Comment ' || CAST(r + 1 AS VARCHAR)",
    "ticket": f"'TKT-' || CAST({int_sql(10_000, 99_999, _n('ticket'))} AS VARCHAR)",
    "agent": f"'AGT-' || CAST({int_sql(100, 999, _n('agent'))} AS VARCHAR)",
    "is_active": f"{_n('is_active')} < {2**31}",
    "signup_on": f"CAST(CAST(DATE '2022-01-01' + CAST({int_sql(0, 1460, _n('signup_on'))} AS INTEGER) AS DATE) AS VARCHAR)",
    "created": f"CAST(CAST(DATE '2022-01-01' + CAST({int_sql(0, 1460, _n('created'))} AS INTEGER) AS TIMESTAMP) + to_minutes({int_sql(0, 1439, draw_sql('created', 1))}) AS VARCHAR)",
    "points": int_sql(1, 100_000, _n("points")),
    "score": scaled_sql(0, 10_000, 2, _n("score")),
    "remark": "'remark_' || CAST(r + 1 AS VARCHAR)",
}
TYPES = {
    "client_id": "bigint", "latitude": "double", "longitude": "double", "rating": "double", "amount": "double",
    "guests": "bigint", "sort_order": "bigint", "is_active": "boolean", "signup_on": "date",
    "created": "timestamp_ntz", "points": "bigint", "score": "double",
}
OPTIONAL = {"email", "phone"}


@query("synth_clients", "SELECT " + ", ".join(f"{sql} AS {c}" for c, sql in SYNTH_SQL.items()) + " FROM (SELECT c_custkey AS r FROM customer)")
def synth_clients(spark, sf_dir):
    """A synthetic client per customer, values by column name and type."""
    specs = [ColumnSpec(c, TYPES.get(c, "string"), c in OPTIONAL) for c in SYNTH_SQL]
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    out = synth.generate(rows, F.col("c_custkey"), NAME, specs, seed=SEED)
    return out.withColumns({c: F.col(c).cast("string") for c in ("signup_on", "created")})


@query(
    "synth_from_samples",
    """
    WITH s AS (SELECT list(v ORDER BY v) AS vs FROM (SELECT DISTINCT c_mktsegment AS v FROM customer WHERE c_mktsegment IS NOT NULL ORDER BY v LIMIT 5))
    SELECT o_orderkey + 1001 AS client_id, vs[CAST(o_orderkey % len(vs) + 1 AS BIGINT)] AS segment FROM orders, s
    """,
)
def synth_from_samples(spark, sf_dir):
    """Values cycle through the samples a profile found; one row per order."""
    columns = profile.profile(table(spark, sf_dir, "customer").select("c_mktsegment"), "customer")
    samples = columns.first()["sample_values"]  # at most five values
    specs = [ColumnSpec("client_id", "bigint", False), ColumnSpec("segment", "string", False, samples)]
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    return synth.generate(rows, F.col("o_orderkey"), NAME, specs)


@query(
    "synth_with_rules",
    "SELECT r + 1001 AS client_id, "
    + pick_sql(["confirmed", "pending"], draw_sql("booking_status"))
    + " AS booking_status, "
    + pick_sql(["gold", "silver", "bronze"], draw_sql("tier"))
    + " AS tier FROM (SELECT c_custkey AS r FROM customer)",
)
def synth_with_rules(spark, sf_dir):
    """Business rules restrict the values of a column."""
    specs = [ColumnSpec("client_id", "bigint", False), ColumnSpec("booking_status"), ColumnSpec("tier")]
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    rules = "booking_status must be confirmed or pending; tier must be one of: gold, silver, bronze"
    return synth.generate(rows, F.col("c_custkey"), NAME, specs, seed=SEED, rules=rules)


@query(
    "synth_masked",
    """
    SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS c_name, c_mktsegment
    FROM customer WHERE CAST('0x' || substr(md5('5:' || CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) < CAST(floor(0.25 * 4294967296) AS BIGINT)
    """,
)
def synth_masked(spark, sf_dir):
    """A quarter of the real customers, names masked."""
    customer = table(spark, sf_dir, "customer")
    out = synth.masked(customer, F.col("c_custkey"), 0.25, ["c_name"], seed=5)
    return out.select("c_custkey", "c_name", "c_mktsegment")


@query(
    "synth_from_values",
    """
    WITH s AS (SELECT list(v ORDER BY v) AS vs FROM (SELECT DISTINCT p_name AS v FROM part WHERE p_name IS NOT NULL))
    SELECT o_orderkey, vs[CAST(o_orderkey % len(vs) + 1 AS BIGINT)] AS p_name FROM orders, s
    """,
)
def synth_from_values(spark, sf_dir):
    """Every distinct part name takes its turn; one row per order."""
    t = tables(spark, sf_dir, "orders", "part")
    return synth.from_values(t["orders"].select("o_orderkey"), F.col("o_orderkey"), t["part"], "p_name")


TABLE_COLUMNS = ["client_id", "guests", "rating", "sort_order", "ticket", "points"]


@query(
    "synth_table",
    "SELECT " + ", ".join(f"{SYNTH_SQL[c]} AS {c}" for c in TABLE_COLUMNS) + " FROM (SELECT unnest(range((SELECT count(*) FROM orders))) AS r)",
)
def synth_table(spark, sf_dir):
    """A synthetic table with as many rows as there are orders."""
    n = table(spark, sf_dir, "orders").count()
    return synth.table(spark, NAME, [ColumnSpec(c, TYPES.get(c, "string"), False) for c in TABLE_COLUMNS], rows=n, seed=SEED)
