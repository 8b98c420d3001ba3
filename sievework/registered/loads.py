"""Ingestion, sinks and streams: written to the shared folder, read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.operators.checks import Rule
from sievework.plans import ingest, suite
from sievework.plans.ingest import IngestSpec
from sievework.registered.quality import AS_OF, SUITE, row_sql, suite_results
from sievework.registered.registry import query, scratch_schema, stream_place, table, tables
from sievework.session import cut, scratch
from sievework.sources import buckets, evolving, files, sinks
from sievework.streaming import changes, quality

LOADED = "2024-01-31"
EVENT_COLUMNS = ["event_id", "user_id", "event_type", "value", "ts"]
EVENTS_LOADED = """
    SELECT event_id, user_id, event_type, value, CAST(ts AS VARCHAR) AS ts, '2024-01-31 00:00:00' AS load_date, 'web.events' AS record_source FROM events
"""


def shown(df):
    return df.withColumns({c: F.col(c).cast("string") for c in ("ts", "load_date")})


def event_spec(spark, sf_dir, load_type: str, **more) -> IngestSpec:
    schema, folder = scratch_schema(spark)
    path, options = stream_place(spark, sf_dir, "events")
    return IngestSpec(
        "events", load_type=load_type, source_path=path, options=options, target_schema=schema,
        checkpoint_base=f"{folder}/checkpoints", columns=EVENT_COLUMNS, record_source="web", load_date=LOADED, **more,
    )


@query("ingest_full", EVENTS_LOADED)
def ingest_full(spark, sf_dir):
    spec = event_spec(spark, sf_dir, "full")
    ingest.run(spark, spec)
    return shown(spark.table(spec.target))


@query("ingest_incremental", EVENTS_LOADED)
def ingest_incremental(spark, sf_dir):
    """Run twice; the second run finds no new file."""
    spec = event_spec(spark, sf_dir, "incremental")
    ingest.run(spark, spec)
    ingest.run(spark, spec)
    return shown(spark.table(spec.target))


@query("ingest_streaming", EVENTS_LOADED)
def ingest_streaming(spark, sf_dir):
    """A continuous stream, stopped once it has caught up."""
    spec = event_spec(spark, sf_dir, "streaming", trigger="1 second")
    stream = ingest.run(spark, spec)
    stream.processAllAvailable()
    stream.stop()
    return shown(spark.table(spec.target))


@query("ingest_merge", EVENTS_LOADED)
def ingest_merge(spark, sf_dir):
    """Keyed load of the events, which are unique by event_id."""
    spec = event_spec(spark, sf_dir, "merge", keys=["event_id"], sequence=["ts"])
    ingest.run(spark, spec)
    return shown(spark.table(spec.target))


@query(
    "ingest_csv",
    "SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance, 'crm.customer' AS record_source FROM customer GROUP BY 1",
)
def ingest_csv(spark, sf_dir):
    """CSV files with a header, streamed under a kept schema."""
    customer = table(spark, sf_dir, "customer")
    path = scratch(spark, "customer-csv")
    sinks.write_result(customer, path, "csv")
    schema, folder = scratch_schema(spark)
    spec = IngestSpec(
        "customer", schema=customer.schema, source_format="csv", source_path=path, target_schema=schema,
        checkpoint_base=f"{folder}/checkpoints", record_source="crm",
    )
    ingest.run(spark, spec)
    loaded = spark.table(spec.target)
    return loaded.groupBy("c_mktsegment").agg(
        F.count("*").alias("n"),
        F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"),
        F.max("record_source").alias("record_source"),
    )


@query(
    "ingest_configs",
    " UNION ALL ".join(
        f"SELECT '{t}' AS source_table, 'bronze.{t}' AS target_table, 'incremental' AS load_type, '/chk/source/{t}/' AS source_path, "
        f"'/chk/{t}/checkpoint' AS checkpoint_location, '/chk/{t}/schema' AS schema_location, '{c}' AS selected, count(*) AS n FROM {t}"
        for t, c in (
            ("orders", "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority"),
            ("customer", "c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment"),
        )
    ),
)
def ingest_configs(spark, sf_dir):
    """One configuration per table, with the rows it would load."""
    t = tables(spark, sf_dir, "orders", "customer")
    specs = [IngestSpec(name, schema=df.schema, checkpoint_base="/chk") for name, df in t.items()]
    sizes = None
    for name, df in t.items():
        one = df.agg(F.count("*").alias("n")).withColumn("source_table", F.lit(name))
        sizes = one if sizes is None else sizes.unionByName(one)
    return ingest.describe(specs, spark).join(sizes, "source_table").select(
        "source_table", "target_table", "load_type", "source_path", "checkpoint_location", "schema_location",
        F.array_join("selected_columns", ",").alias("selected"), "n",
    )


@query(
    "ingest_evolving",
    """
    SELECT event_id, user_id, CASE WHEN third = 2 AND event_id % 5 = 0 THEN NULL ELSE value END AS value, CAST(ts AS VARCHAR) AS ts,
      CASE WHEN third >= 1 THEN event_type END AS event_type,
      CASE WHEN third = 2 AND event_id % 5 = 0 THEN '{"value":"about ' || event_id || '"}' END AS _rescued FROM (SELECT *, event_id % 3 AS third FROM events)
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, '{"_line":"no object"}'
    """,
)
def ingest_evolving(spark, sf_dir):
    """Three deliveries of events: the second has a column more, in the third some values are texts and a line is broken."""
    feed, target, log = (scratch(spark, name) for name in ("feed", "evolving", "schema-log"))
    events = table(spark, sf_dir, "events")
    number = F.col("value").cast("string")
    odd = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("about "), F.col("event_id").cast("string"))).otherwise(number)
    deliveries = [["event_id", "user_id", "value", "ts"], ["event_id", "user_id", "value", "ts", "event_type"], ["event_id", "user_id", odd.alias("value"), "ts", "event_type"]]
    for third, shape in enumerate(deliveries):
        part = events.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).filter(F.col("event_id") % 3 == third).select(*shape)
        lines = part.select(F.to_json(F.struct(*part.columns)).alias("value"))
        if third == 2:
            lines = lines.unionByName(spark.createDataFrame([("no object",)], "value string"))
        lines.write.mode("append").text(feed)
        evolving.load(spark, feed, target, log, f"{log}-checkpoint", availableNow=True, pattern="*.txt").awaitTermination()
    found = evolving.read(spark, target, log)
    return found.select("event_id", "user_id", "value", F.col("ts").cast("string").alias("ts"), "event_type", "_rescued")


@query(
    "registry_append",
    " UNION ALL ".join(f"SELECT rule_type, failures, 2 * count(*) AS copies FROM ({row_sql(r, sql)}) GROUP BY 1, 2, column_name, table_name" for r, sql in SUITE),
)
def registry_append(spark, sf_dir):
    """Suite results appended to a result registry twice, and parsed again."""
    schema, _ = scratch_schema(spark)
    registry = f"{schema}.suite_results"
    results = cut(suite_results(spark, sf_dir))  # evaluated once
    for stamp in ("2024-01-31T00:00:00Z", "2024-02-01T00:00:00Z"):
        sinks.register_results(results, registry, stamp)
    row = "table_name STRING, rule_type STRING, column_name STRING, failures BIGINT"
    parsed = spark.table(registry).select(F.from_json("result_json", row).alias("r")).select("r.*")
    return parsed.groupBy("rule_type", "failures", "column_name", "table_name").agg(F.count("*").alias("copies")).select(
        "rule_type", "failures", "copies"
    )


@query(
    "export_results",
    " UNION ALL ".join(
        f"SELECT '{fmt}' AS format, l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem GROUP BY 2, 3"
        for fmt in ("json", "csv")
    ),
)
def export_results(spark, sf_dir):
    """A summary exported as JSON and as CSV, read back."""
    summary = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity")
    )
    out = None
    for fmt in ("json", "csv"):
        path = scratch(spark, f"export-{fmt}")
        sinks.write_result(summary, path, fmt)
        one = files.read(spark, path, fmt, schema=summary.schema).withColumn("format", F.lit(fmt))
        out = one if out is None else out.unionByName(one)
    return out


@query("target_ddl", "SELECT o_orderstatus, count(*) AS n, true AS key_required FROM orders GROUP BY 1")
def target_ddl(spark, sf_dir):
    """A table created from a schema with a required key, then filled."""
    schema, _ = scratch_schema(spark)
    orders = table(spark, sf_dir, "orders")
    required = T.StructType([T.StructField(f.name, f.dataType, f.name != "o_orderkey") for f in orders.schema])
    sinks.create_table(spark, f"{schema}.orders", required)
    orders.write.insertInto(f"{schema}.orders")
    statement = sinks.ddl(f"{schema}.orders", required)
    return spark.table(f"{schema}.orders").groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.lit("`o_orderkey` BIGINT NOT NULL" in statement).alias("key_required")
    )


@query(
    "upsert_orders",
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders
    UNION ALL SELECT -1 - o_orderkey, 'N' FROM orders WHERE o_orderstatus = 'F'
    """,
)
def upsert_orders(spark, sf_dir):
    """Changed and new orders merged into a table, twice with the same outcome."""
    schema, _ = scratch_schema(spark)
    target = f"{schema}.orders"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    finished = orders.filter("o_orderstatus = 'F'")
    changed = finished.withColumn("o_orderstatus", F.lit("X")).unionByName(
        finished.select((-1 - F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"))
    )
    sinks.upsert(orders, target, ["o_orderkey"])
    sinks.upsert(changed, target, ["o_orderkey"])
    sinks.upsert(changed, target, ["o_orderkey"])
    return spark.table(target)


UPSERTED_LINES = """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 50 = 3 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, l_returnflag
    FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)
    UNION ALL SELECT -1 - l_orderkey, l_linenumber, 0, 'NEW' FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 50 = 3)
"""


@query("upsert_buckets", UPSERTED_LINES)
def upsert_buckets(spark, sf_dir):
    """All order lines, then changed and new ones, into hash buckets; the second load runs twice and the table is cut anew in between."""
    schema, _ = scratch_schema(spark)
    target, keys = f"{schema}.lines", ["l_orderkey", "l_linenumber"]
    lines = table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.max("l_quantity").alias("l_quantity"), F.max("l_returnflag").alias("l_returnflag"))
    some = lines.filter("l_orderkey % 50 = 3")
    changed = some.withColumn("l_quantity", F.col("l_quantity") + 1).unionByName(
        some.select((-1 - F.col("l_orderkey")).alias("l_orderkey"), "l_linenumber", F.lit(0).cast("double").alias("l_quantity"), F.lit("NEW").alias("l_returnflag"))
    )
    buckets.upsert(lines, target, keys, 16)
    buckets.upsert(changed, target, keys, 16)
    buckets.rebucket(spark, target, 24)
    if buckets.upsert(changed, target, keys, 16):
        raise ValueError("a load that ran twice has written files")
    return spark.table(target)


@query("ingest_merge_buckets", EVENTS_LOADED)
def ingest_merge_buckets(spark, sf_dir):
    """Keyed load of the events into hash buckets, run twice."""
    spec = event_spec(spark, sf_dir, "merge", keys=["event_id"], sequence=["ts"], buckets=16)
    ingest.run(spark, spec)
    ingest.run(spark, spec)
    return shown(spark.table(spec.target))


@query(
    "load_strategies",
    """
    SELECT 'APPEND' AS strategy, 2 * count(*) AS n FROM supplier
    UNION ALL SELECT 'FULL_REFRESH', count(*) FROM supplier
    UNION ALL SELECT 'MERGE', count(*) FROM supplier
    """,
)
def load_strategies(spark, sf_dir):
    """Each strategy applied twice to the same rows."""
    schema, _ = scratch_schema(spark)
    supplier = table(spark, sf_dir, "supplier")
    out = None
    for strategy in sinks.LOAD_STRATEGIES:
        target = f"{schema}.supplier_{strategy.lower()}"
        for _ in range(2):
            sinks.load(supplier, target, strategy, keys=["s_suppkey"])
        one = spark.table(target).agg(F.count("*").alias("n")).withColumn("strategy", F.lit(strategy))
        out = one if out is None else out.unionByName(one)
    return out


def event_stream(spark, sf_dir):
    path, options = stream_place(spark, sf_dir, "events")
    return files.stream(spark, path, "parquet", table(spark, sf_dir, "events").schema, **options)


@query(
    "stream_dq_daily",
    """
    SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS rows,
      count(*) FILTER (value < 5) AS null_value, CAST(0 AS BIGINT) AS null_user_id FROM events GROUP BY 1, 2
    """,
)
def stream_dq_daily(spark, sf_dir):
    """Rows and NULLs per day and event type; values under 5 have gone missing."""
    stream = event_stream(spark, sf_dir).withColumn("value", F.when(F.col("value") >= 5, F.col("value")))
    counts = quality.windowed_counts(stream, "ts", ["event_type"], ["value", "user_id"])
    path = scratch(spark, "windows")
    quality.write_updates(counts, path, f"{path}-checkpoint", availableNow=True).awaitTermination()
    rows = quality.read_updates(spark, path, ["window_start", "event_type"])
    day = F.date_format("window_start", "yyyy-MM-dd").alias("day")
    return rows.select(day, "event_type", "rows", "null_value", "null_user_id")


@query("stream_dedupe", "SELECT event_id, user_id FROM events")
def stream_dedupe(spark, sf_dir):
    """Every event arrives twice, one copy of each is kept."""
    stream = event_stream(spark, sf_dir)
    doubled = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    kept = quality.first_rows(doubled, "ts", ["event_id"]).select("event_id", "user_id")
    path = scratch(spark, "deduped")
    writer = kept.writeStream.option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True)
    writer.foreachBatch(quality.per_batch(path)).start().awaitTermination()
    return spark.read.option("basePath", path).parquet(path).select("event_id", "user_id")


@query(
    "stream_first_rows",
    """
    SELECT actor, event_id, event_type FROM (SELECT CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS actor, event_id, event_type, ts FROM events)
    QUALIFY row_number() OVER (PARTITION BY actor ORDER BY ts, event_id) = 1
    """,
)
def stream_first_rows(spark, sf_dir):
    """The first event of each actor, a third of all events on one; files of later events arrive between two runs of the stream."""
    schema, folder = scratch_schema(spark)
    path, feed = scratch(spark, "first-rows"), scratch(spark, "feed")
    events = table(spark, sf_dir, "events").withColumn("actor", F.when(F.col("event_id") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("user_id")))
    moment = F.unix_micros(F.col("ts").cast("timestamp"))
    half = events.agg(F.percentile_approx(moment, 0.5)).scalar()
    for part in (moment <= half, moment > half):
        events.filter(part).select("actor", "event_id", "event_type", "ts").write.mode("append").parquet(feed)
        stream = files.stream(spark, feed, "parquet", "actor long, event_id long, event_type string, ts timestamp_ntz")
        quality.write_first_rows(
            stream, "ts", ["actor"], ["ts", "event_id"], path, f"{schema}.actors", 16, f"{folder}/first-checkpoint", availableNow=True
        ).awaitTermination()
    return spark.read.option("basePath", path).parquet(path).select("actor", "event_id", "event_type")


@query(
    "stream_quarantine",
    """
    SELECT verdict, broken, count(*) AS n FROM (
      SELECT CASE WHEN event_type = 'error' OR value > 90 THEN 'bad' ELSE 'good' END AS verdict,
        CASE WHEN event_type = 'error' AND value > 90 THEN 'ENUM_CHECK_event_type,RANGE_CHECK_value'
          WHEN event_type = 'error' THEN 'ENUM_CHECK_event_type' WHEN value > 90 THEN 'RANGE_CHECK_value' ELSE '' END AS broken FROM events)
    GROUP BY 1, 2
    """,
)
def stream_quarantine(spark, sf_dir):
    """Bad rows of a stream set aside with the rules they break."""
    rules = [
        Rule("events", "ENUM_CHECK", "event_type", params={"values": ["click", "purchase", "signup", "view"]}),
        Rule("events", "RANGE_CHECK", "value", params={"max": "90"}),
    ]
    path = scratch(spark, "split")
    stream = event_stream(spark, sf_dir)
    quality.write_split(stream, rules, path, f"{path}-checkpoint", AS_OF, availableNow=True).awaitTermination()
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.groupBy("verdict", F.array_join("broken_rules", ",").alias("broken")).agg(F.count("*").alias("n"))


@query(
    "stream_apply_changes",
    "SELECT user_id, event_type, event_id, CAST(ts AS VARCHAR) AS ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def stream_apply_changes(spark, sf_dir):
    """The event feed as changes to users: the newest row of each remains."""
    schema, folder = scratch_schema(spark)
    stream = event_stream(spark, sf_dir).select("user_id", "event_type", "event_id", "ts")
    target = f"{schema}.users"
    query_ = changes.apply_changes(
        stream, target, ["user_id"], ["ts", "event_id"], f"{folder}/users-checkpoint", availableNow=True
    )
    query_.awaitTermination()
    return spark.table(target).withColumn("ts", F.col("ts").cast("string"))


@query(
    "stream_changes_buckets",
    "SELECT user_id, event_type, event_id, CAST(ts AS VARCHAR) AS ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def stream_changes_buckets(spark, sf_dir):
    """The event feed in two streams, one after the other: changes that come late do not undo newer ones."""
    schema, folder = scratch_schema(spark)
    target = f"{schema}.users"
    for half, side in enumerate(("event_id % 2 = 1", "event_id % 2 = 0")):
        stream = event_stream(spark, sf_dir).filter(side).select("user_id", "event_type", "event_id", "ts")
        checkpoint = f"{folder}/users-checkpoint-{half}"
        changes.apply_changes(stream, target, ["user_id"], ["ts", "event_id"], checkpoint, 16, availableNow=True).awaitTermination()
    return spark.table(target).withColumn("ts", F.col("ts").cast("string"))


@query(
    "stream_suite",
    " UNION ALL ".join(
        row_sql(r, sql)
        for r, sql in (
            (Rule("events", "NOT_NULL", "user_id"), "SELECT count(*) FROM events WHERE user_id IS NULL"),
            (Rule("events", "UNIQUE", "event_id"), "SELECT count(*) - count(DISTINCT event_id) FROM events"),
        )
    ),
)
def stream_suite(spark, sf_dir):
    """A suite over a table that a stream has filled."""
    spec = event_spec(spark, sf_dir, "incremental")
    ingest.run(spark, spec)
    rules = [Rule("events", "NOT_NULL", "user_id"), Rule("events", "UNIQUE", "event_id")]
    results = suite.run({"events": spark.table(spec.target)}, rules, AS_OF)
    return results.select("table_name", "rule_type", "column_name", "failures", "passed")
