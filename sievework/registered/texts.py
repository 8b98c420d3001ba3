"""Text corpora, run-log analytics, stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import SPACE
from sievework.operators import artifacts, corpus, passages, runlog
from sievework.registered.registry import query, scratch_schema, table
from sievework.session import scratch
from sievework.sources import files, sinks

CHUNK_TOKENS = 100
LINES = "\n"
QUERY_WORDS = {"data": ["data", "table"], "license": ["license", "copyright", "rights"], "none": []}



def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


CHUNKS = f"""
    WITH RECURSIVE docs AS (
      SELECT doc_id, list_filter(list_transform(string_split({strip_sql('text')}, chr(10)), lambda p: {strip_sql('p')}), lambda p: length(p) > 0) AS ps,
        '[Source: ' || doc_id || ']' AS source FROM documents),
    walk AS (
      SELECT doc_id, 0 AS i, 0 AS chunk_no, length(source) + 1 AS used, CAST(NULL AS VARCHAR) AS p FROM docs
      UNION ALL
      SELECT w.doc_id, w.i + 1,
        CASE WHEN w.used + length(d.ps[w.i + 1]) + 2 <= {CHUNK_TOKENS * 4} THEN w.chunk_no ELSE w.chunk_no + 1 END,
        CASE WHEN w.used + length(d.ps[w.i + 1]) + 2 <= {CHUNK_TOKENS * 4} THEN w.used ELSE length(d.source) + 1 END + length(d.ps[w.i + 1]) + 2,
        d.ps[w.i + 1]
      FROM walk w JOIN docs d ON w.doc_id = d.doc_id WHERE w.i < len(d.ps)),
    chunks AS (
      SELECT w.doc_id, chunk_no, any_value(source) || coalesce(chr(10) || string_agg(p, chr(10) || chr(10) ORDER BY i), '') AS chunk
      FROM walk w JOIN docs d ON w.doc_id = d.doc_id GROUP BY w.doc_id, chunk_no)
"""


def doc_chunks(spark, sf_dir) -> DataFrame:
    return corpus.chunks(table(spark, sf_dir, "documents"), CHUNK_TOKENS, separator=LINES)


@query("corpus_chunks", CHUNKS + " SELECT doc_id, chunk_no, md5(chunk) AS chunk_md5, length(chunk) AS n_chars FROM chunks")
def corpus_chunks(spark, sf_dir):
    """Documents packed into passages, line by line."""
    return doc_chunks(spark, sf_dir).select(
        "doc_id", "chunk_no", F.md5("chunk").alias("chunk_md5"), F.length("chunk").cast("bigint").alias("n_chars")
    )


@query("corpus_chunks_blank", CHUNKS + " SELECT doc_id, chunk_no, md5(chunk) AS chunk_md5, length(chunk) AS n_chars FROM chunks")
def corpus_chunks_blank(spark, sf_dir):
    """Paragraphs that blank lines part, some of them with blanks in the line, packed into passages."""
    apart = F.replace("text", F.lit("\n"), F.when(F.col("doc_id") % 2 == 0, F.lit("\n \t\n")).otherwise(F.lit("\n\n")))
    docs = table(spark, sf_dir, "documents").withColumn("text", apart)
    return corpus.chunks(docs, CHUNK_TOKENS).select(
        "doc_id", "chunk_no", F.md5("chunk").alias("chunk_md5"), F.length("chunk").cast("bigint").alias("n_chars")
    )


def count_sql(word: str) -> str:
    return f"((length(lower(chunk)) - length(replace(lower(chunk), '{word}', ''))) // {len(word)})"


TOP = (
    CHUNKS
    + ", scored AS ("
    + " UNION ALL ".join(
        f"SELECT '{q}' AS query, {' + '.join(map(count_sql, words)) or '0'} AS score, doc_id, chunk_no, chunk FROM chunks"
        for q, words in QUERY_WORDS.items()
    )
    + "), ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id, chunk_no) AS place FROM scored)"
)


@query("corpus_score_topk", TOP + " SELECT query, CAST(score AS BIGINT) AS score, doc_id, chunk_no, CAST(place AS INTEGER) AS place FROM ranked WHERE place <= 3")
def corpus_score_topk(spark, sf_dir):
    return corpus.top_k(doc_chunks(spark, sf_dir), QUERY_WORDS, 3).select("query", "score", "doc_id", "chunk_no", "place")


@query("corpus_search", TOP + " SELECT query, CAST(score AS BIGINT) AS score, doc_id, chunk_no, CAST(place AS INTEGER) AS place FROM ranked WHERE place <= 3")
def corpus_search(spark, sf_dir):
    """The same best passages from stored trigram postings: only passages that can hold a keyword are scored."""
    path = scratch(spark, "passages")
    passages.build(doc_chunks(spark, sf_dir), path)
    return passages.search(spark, path, QUERY_WORDS, 3).select("query", "score", "doc_id", "chunk_no", "place")


@query(
    "corpus_budget",
    TOP
    + """
    SELECT query, CAST(place AS INTEGER) AS place, tokens, CAST(used AS BIGINT) AS used FROM (
      SELECT query, place, greatest(1, length(chunk) // 4) AS tokens,
        sum(greatest(1, length(chunk) // 4)) OVER (PARTITION BY query ORDER BY place) AS used FROM ranked WHERE place <= 3)
    WHERE used <= 250 - 20
    """,
)
def corpus_budget(spark, sf_dir):
    ranked = corpus.top_k(doc_chunks(spark, sf_dir), QUERY_WORDS, 3)
    return corpus.fit_budget(ranked, max_tokens=250, reserved=20).select("query", "place", "tokens", "used")


@query(
    "corpus_tokens",
    "SELECT doc_id, greatest(1, length(text) // 4) AS tokens, greatest(1, length(text) // 4) > 300 AS over_budget FROM documents",
)
def corpus_tokens(spark, sf_dir):
    return corpus.over_budget(table(spark, sf_dir, "documents"), "text", 300).select("doc_id", "tokens", "over_budget")


@query(
    "corpus_keywords",
    f"""
    SELECT DISTINCT conv_id, w AS keyword FROM (
      SELECT conv_id, regexp_replace(unnest(string_split_regex({strip_sql('lower(text)')}, '{SPACE}+')), '^[.,;:()''"]+|[.,;:()''"]+$', '', 'g') AS w
      FROM conversations WHERE role = 'user')
    WHERE length(w) > 3 AND w NOT IN ({", ".join(f"'{w}'" for w in corpus.STOP_WORDS)})
    """,
)
def corpus_keywords(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return corpus.keywords(asked, "conv_id", "text")


@query(
    "corpus_metadata_keywords",
    "SELECT DISTINCT lower(w) AS keyword FROM (SELECT unnest(['dq', 'rules', p_brand, p_type]) AS w FROM part)",
)
def corpus_metadata_keywords(spark, sf_dir):
    """Keywords of an inventory: here each part's brand is a table and its type a column."""
    columns = table(spark, sf_dir, "part").select(F.col("p_brand").alias("table_name"), F.col("p_type").alias("name"))
    return corpus.metadata_keywords(columns, "dq_rules")


# -- run log: every conversation is a run -----------------------------------------------------------


def runs(spark, sf_dir) -> DataFrame:
    """One run per conversation: tokens by role, model and agent by whether a system turn is there."""
    tokens = corpus.tokens(F.col("text"))
    reply = F.col("role") == "assistant"
    log = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.coalesce(F.sum(F.when(~reply, tokens)), F.lit(0)).alias("token_prompt"),
        F.coalesce(F.sum(F.when(reply, tokens)), F.lit(0)).alias("token_completion"),
        F.bool_or(F.col("role") == "system").alias("guided"),
        F.count_if(reply).alias("replies"),
        F.count("*").alias("turns"),
    )
    return log.select(
        "conv_id",
        F.when(F.col("guided"), "guide").otherwise("chat").alias("agent_id"),
        F.when(F.col("guided"), "some-Claude-model").otherwise("open-model").alias("model"),
        F.when(F.col("replies") > 0, "success").otherwise("error").alias("status"),
        F.when(F.col("replies") == 0, "no reply").alias("error"),
        (F.col("turns") * 1.5).cast("double").alias("duration_s"),
        "token_prompt",
        "token_completion",
    )


RUNS = """
    (SELECT conv_id, CASE WHEN guided THEN 'guide' ELSE 'chat' END AS agent_id, CASE WHEN replies > 0 THEN 'success' ELSE 'error' END AS status,
      CASE WHEN replies = 0 THEN 'no reply' END AS error, turns * 1.5::DOUBLE AS duration_s, token_prompt, token_completion,
      round_even(token_prompt / 1e6 * CASE WHEN guided THEN 15.0 ELSE 5.0 END + token_completion / 1e6 * CASE WHEN guided THEN 75.0 ELSE 15.0 END, 6) AS cost_usd
    FROM (SELECT conv_id, CAST(coalesce(sum(greatest(1, length(text) // 4)) FILTER (role <> 'assistant'), 0) AS BIGINT) AS token_prompt,
        CAST(coalesce(sum(greatest(1, length(text) // 4)) FILTER (role = 'assistant'), 0) AS BIGINT) AS token_completion,
        bool_or(role = 'system') AS guided, count(*) FILTER (role = 'assistant') AS replies, count(*) AS turns
      FROM conversations GROUP BY conv_id))
"""


@query("runlog_cost", f"SELECT conv_id, token_prompt, token_completion, cost_usd FROM {RUNS}")
def runlog_cost(spark, sf_dir):
    return runlog.with_cost(runs(spark, sf_dir)).select("conv_id", "token_prompt", "token_completion", "cost_usd")


@query(
    "runlog_totals",
    f"""
    SELECT agent_id, count(*) AS runs, CAST(sum(token_prompt) AS BIGINT) AS token_prompt, CAST(sum(token_completion) AS BIGINT) AS token_completion,
      CAST(sum(token_prompt + token_completion) AS BIGINT) AS token_total, CAST(sum(CAST(cost_usd AS DECIMAL(20,6))) AS DOUBLE) AS cost_usd
    FROM {RUNS} GROUP BY ROLLUP (agent_id)
    """,
)
def runlog_totals(spark, sf_dir):
    return runlog.totals(runlog.with_cost(runs(spark, sf_dir)))


@query(
    "runlog_dedupe",
    """
    SELECT md5(role || '|' || text) AS content, CAST(min(conv_id * 1000 + turn) AS BIGINT) AS first_run, count(*) AS runs
    FROM conversations GROUP BY role, text
    """,
)
def runlog_dedupe(spark, sf_dir):
    """Repeated inputs share the first run's result."""
    log = table(spark, sf_dir, "conversations").withColumn("run", F.col("conv_id") * 1000 + F.col("turn"))
    asked = log.withColumn("result", F.struct(F.md5(F.concat_ws("|", "role", "text")).alias("content"), F.col("run").alias("first_run")))
    kept = runlog.first_results(asked, ["role", "text"], ["run"], "result")
    return kept.select("result.content", "result.first_run", "runs")


@query(
    "runlog_last_n",
    f"SELECT agent_id, conv_id, CAST(place AS INTEGER) AS place FROM (SELECT agent_id, conv_id, row_number() OVER (PARTITION BY agent_id ORDER BY conv_id DESC) AS place FROM {RUNS}) WHERE place <= 20",
)
def runlog_last_n(spark, sf_dir):
    """The 20 newest runs of each agent."""
    kept = runlog.latest(runs(spark, sf_dir), runlog.KEPT_RUNS, [F.desc("conv_id")], by="agent_id")
    return kept.select("agent_id", "conv_id", "place")


@query("runlog_history", f"SELECT agent_id, conv_id, status FROM {RUNS} ORDER BY conv_id DESC LIMIT 10")
def runlog_history(spark, sf_dir):
    """The 10 newest runs."""
    return runlog.latest(runs(spark, sf_dir), runlog.SHOWN_RUNS, [F.desc("conv_id")]).select("agent_id", "conv_id", "status")


@query(
    "runlog_status",
    f"""
    SELECT agent_id, status, count(*) AS runs, min(duration_s) AS min_duration_s, round(avg(duration_s), 6) AS avg_duration_s,
      max(duration_s) AS max_duration_s, arg_max(error, conv_id) FILTER (error IS NOT NULL) AS last_error FROM {RUNS} GROUP BY 1, 2
    """,
)
def runlog_status(spark, sf_dir):
    return runlog.status_summary(runs(spark, sf_dir), ["conv_id"]).withColumn("avg_duration_s", F.round("avg_duration_s", 6))


@query("runlog_table", f"SELECT agent_id, status, count(*) AS runs, CAST(sum(token_prompt + token_completion) AS BIGINT) AS token_total FROM {RUNS} GROUP BY 1, 2")
def runlog_table(spark, sf_dir):
    """Runs appended to the run-log table and read back."""
    schema, _ = scratch_schema(spark)
    log = sinks.create_run_log(spark, schema)
    rows = runlog.with_cost(runs(spark, sf_dir)).select(
        F.col("conv_id").cast("string").alias("run_id"), "agent_id", "status", "token_prompt", "token_completion",
        (F.col("token_prompt") + F.col("token_completion")).alias("token_total"), "cost_usd", "duration_s", "error",
        F.lit("2024-01-31 00:00:00").cast("timestamp").alias("timestamp"),
    )
    rows.write.insertInto(log)
    return spark.table(log).groupBy("agent_id", "status").agg(
        F.count("*").alias("runs"), F.sum("token_total").alias("token_total")
    )


@query(
    "registry_filter",
    "SELECT p_partkey FROM part WHERE p_size > 10 AND p_brand = (SELECT min(p_brand) FROM part) AND p_type = (SELECT min(p_type) FROM part WHERE p_brand = (SELECT min(p_brand) FROM part))",
)
def registry_filter(spark, sf_dir):
    """Registry rows by type, category and enabled flag; parts stand for registered agents."""
    part = table(spark, sf_dir, "part")
    registry = part.select(
        "p_partkey", F.col("p_brand").alias("type"), F.col("p_type").alias("category"), (F.col("p_size") > 10).alias("enabled")
    )
    brand = part.agg(F.min("p_brand").alias("b")).scalar()
    kind = part.filter(F.col("p_brand") == brand).agg(F.min("p_type").alias("t")).scalar()
    return runlog.registered(registry, agent_type=brand, category=kind).select("p_partkey")


# -- stored results: one JSON document per part ----------------------------------------------------


def stored(spark, sf_dir, document: Column, agent: str) -> DataFrame:
    """Results written as JSON lines and read back. Outputs of parts over size 25 are fenced, those
    of size 13 are cut off and cannot be read."""
    text = F.to_json(document)
    fenced = F.concat(F.lit("```json\n"), text, F.lit("\n```"))
    output = (
        F.when(F.col("p_size") == 13, F.substring(text, 1, 20)).when(F.col("p_size") > 25, fenced).otherwise(text)
    )
    results = table(spark, sf_dir, "part").select(
        F.lit(agent).alias("agent_id"),
        F.col("p_partkey").cast("string").alias("run_id"),
        output.alias("output"),
        F.struct(F.col("p_partkey").alias("prompt"), F.lit(1).alias("completion"), (F.col("p_partkey") + 1).alias("total")).alias("token_usage"),
    )
    path = scratch(spark, f"results-{agent}")
    sinks.write_result(results, path)
    return files.read_run_results(spark, path, multi_line=False)


def _struct(**fields) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def _rules_document() -> Column:
    def rule(no: int, kind: str, column: Column, priority: str) -> Column:
        return _struct(rule_id=f"DQ_00{no}", rule_type=kind, priority=priority, column=column, fail_action="alert")

    rules = F.array(
        rule(1, "NOT_NULL", F.col("p_name"), "P1"), rule(2, "ENUM_CHECK", F.col("p_type"), "P4")
    )
    one = _struct(table_name=F.col("p_brand"), fully_qualified_name=F.concat(F.lit("erp."), F.col("p_brand")), dq_rules=rules)
    many = F.when(F.col("p_size") > 40, F.array(one, one))
    single = F.col("p_size") <= 40
    return F.struct(
        F.when(single, one["table_name"]).alias("table_name"),
        F.when(single, one["fully_qualified_name"]).alias("fully_qualified_name"),
        F.when(single, rules).alias("dq_rules"),
        many.alias("tables"),
    )


RULE_ROWS = """
    SELECT CAST(p_partkey AS VARCHAR) AS run_id, p_brand AS table_name, 'erp.' || p_brand AS fully_qualified_name, rule_id, rule_type,
      CASE rule_id WHEN 'DQ_001' THEN p_name ELSE p_type END AS "column", priority
    FROM part, (VALUES ('DQ_001', 'NOT_NULL', 'P1'), ('DQ_002', 'ENUM_CHECK', 'P4')) r(rule_id, rule_type, priority),
      generate_series(1, CASE WHEN p_size > 40 THEN 2 ELSE 1 END) WHERE p_size <> 13
"""


@query("artifacts_rules", RULE_ROWS)
def artifacts_rules(spark, sf_dir):
    results = stored(spark, sf_dir, _rules_document(), "dq_recommender")
    return artifacts.rules(results, ["run_id"]).select(
        "run_id", "table_name", "fully_qualified_name", "rule_id", "rule_type", "column", "priority"
    )


@query("artifacts_priorities", f"SELECT priority, count(*) AS rules FROM ({RULE_ROWS}) GROUP BY 1")
def artifacts_priorities(spark, sf_dir):
    return artifacts.by_priority(artifacts.rules(stored(spark, sf_dir, _rules_document(), "dq_recommender")))


@query("artifacts_unreadable", "SELECT CAST(p_partkey AS VARCHAR) AS run_id, p_partkey AS prompt FROM part WHERE p_size = 13")
def artifacts_unreadable(spark, sf_dir):
    results = stored(spark, sf_dir, _rules_document(), "dq_recommender")
    return artifacts.unreadable(results).select("run_id", F.col("token_usage.prompt").alias("prompt"))


@query(
    "artifacts_model",
    """
    SELECT kind AS entity_type, prefix || p_partkey AS table_name, 'MERGE' AS load_strategy, c AS column_name,
      CASE c WHEN 'load_date' THEN 'TIMESTAMP' ELSE 'STRING' END AS data_type, c = 'load_date' AS nullable
    FROM part, (VALUES ('hub', 'HUB_'), ('satellite', 'SAT_')) e(kind, prefix), (VALUES ('part_hk'), ('load_date')) cols(c) WHERE p_size <> 13
    """,
)
def artifacts_model(spark, sf_dir):
    columns = F.array(
        _struct(name="part_hk", data_type="STRING", nullable=False), _struct(name="load_date", data_type="TIMESTAMP", nullable=True)
    )
    entities = F.array(
        *[
            _struct(entity_type=kind, table_name=F.concat(F.lit(prefix), F.col("p_partkey").cast("string")), load_strategy="MERGE", columns=columns)
            for kind, prefix in (("hub", "HUB_"), ("satellite", "SAT_"))
        ]
    )
    flat = artifacts.model_columns(stored(spark, sf_dir, _struct(model_type="data_vault_2", entities=entities), "data_model_gen"))
    return flat.drop("description")


@query(
    "artifacts_tests",
    """
    SELECT 'case' AS kind, 'TC_' || p_partkey AS id, p_type AS detail FROM part WHERE p_size <> 13
    UNION ALL SELECT 'query', 'Q_' || p_partkey, p_name FROM part WHERE p_size <> 13
    UNION ALL SELECT 'check', 'DQ_' || p_partkey, p_brand FROM part WHERE p_size <> 13
    """,
)
def artifacts_tests(spark, sf_dir):
    """Test cases, test queries and rule queries."""

    def named(prefix: str) -> Column:
        return F.concat(F.lit(prefix), F.col("p_partkey").cast("string"))

    cases = _struct(test_cases=F.array(_struct(test_id=named("TC_"), category="functional", description=F.col("p_type"))))
    asked = _struct(queries=F.array(_struct(query_id=named("Q_"), test_description=F.col("p_name"))))
    checks = _struct(queries=F.array(_struct(rule_id=named("DQ_"), monitoring_label=F.col("p_brand"))))
    a = artifacts.test_cases(stored(spark, sf_dir, cases, "test_case_gen"))
    b = artifacts.test_queries(stored(spark, sf_dir, asked, "test_query_gen"))
    c = artifacts.queries(stored(spark, sf_dir, checks, "dq_query_gen"))
    return (
        a.select(F.lit("case").alias("kind"), F.col("test_id").alias("id"), F.col("description").alias("detail"))
        .unionByName(b.select(F.lit("query").alias("kind"), F.col("query_id").alias("id"), F.col("test_description").alias("detail")))
        .unionByName(c.select(F.lit("check").alias("kind"), F.col("rule_id").alias("id"), F.col("monitoring_label").alias("detail")))
    )


@query(
    "artifacts_lineage",
    """
    SELECT p_brand AS "from", p_type AS "to", 'load' AS transformation, CAST(NULL AS VARCHAR) AS node FROM part WHERE p_size <> 13 AND p_size > 5
    UNION ALL SELECT NULL, NULL, NULL, p_name FROM part WHERE p_size <> 13
    """,
)
def artifacts_lineage(spark, sf_dir):
    """Edges and nodes, of graphs with and without edges."""
    edge = _struct(**{"from": F.col("p_brand"), "to": F.col("p_type"), "transformation": "load"})
    graph = F.struct(
        F.array(_struct(id=F.col("p_name"), label=F.col("p_name"))).alias("nodes"),
        F.array_compact(F.array(F.when(F.col("p_size") > 5, edge))).alias("edges"),
    )
    results = stored(spark, sf_dir, F.struct(graph.alias("lineage_graph")), "lineage_creator")
    edges = artifacts.lineage_edges(results).select("from", "to", "transformation", F.lit(None).cast("string").alias("node"))
    nothing = [F.lit(None).cast("string").alias(c) for c in ("from", "to", "transformation")]
    return edges.unionByName(artifacts.lineage_nodes(results).select(*nothing, F.col("id").alias("node")))


@query(
    "artifacts_mappings",
    """
    SELECT 'erp.' || p_brand AS source_table, 'HUB_PART' AS target_table, 'p_partkey' AS source_column, 'part_id' AS target_column,
      'DIRECT COPY' AS transformation_rule FROM part WHERE p_size <> 13
    """,
)
def artifacts_mappings(spark, sf_dir):
    """Mapping documents with and without their outer object."""
    body = _struct(
        source_table=F.concat(F.lit("erp."), F.col("p_brand")),
        target_table="HUB_PART",
        column_mappings=F.array(_struct(source_column="p_partkey", target_column="part_id", transformation_rule="DIRECT COPY")),
    )
    wrapped = F.col("p_size") > 20
    document = F.struct(
        F.when(wrapped, body).alias("sttm"),
        *[F.when(~wrapped, body[c]).alias(c) for c in ("source_table", "target_table", "column_mappings")],
    )
    flat = artifacts.mapping_rows(stored(spark, sf_dir, document, "sttm_gen"))
    return flat.select("source_table", "target_table", "source_column", "target_column", "transformation_rule")


@query(
    "artifacts_profiles",
    """
    SELECT p_brand AS table_name, p_name AS name, p_retailprice AS null_pct, p_partkey AS distinct_count, p_type AS sample FROM part WHERE p_size <> 13
    """,
)
def artifacts_profiles(spark, sf_dir):
    column = _struct(
        name=F.col("p_name"), null_pct=F.col("p_retailprice"), distinct_count=F.col("p_partkey"),
        sample_values=F.array("p_type"),
    )
    document = _struct(profiles=F.array(_struct(table_name=F.col("p_brand"), columns=F.array(column))))
    flat = artifacts.profile_columns(stored(spark, sf_dir, document, "data_profiler"))
    return flat.select("table_name", "name", "null_pct", "distinct_count", F.get("sample_values", F.lit(0)).alias("sample"))


@query(
    "artifacts_samples",
    """
    SELECT p_brand AS table_name, p_name AS name, CASE WHEN p_size > 25 THEN p_type END AS kind FROM part WHERE p_size <> 13
    """,
)
def artifacts_samples(spark, sf_dir):
    """Sample rows; columns a row lacks are NULL."""
    row = F.struct(F.col("p_name").alias("name"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("kind"))
    document = _struct(samples=F.array(_struct(table_name=F.col("p_brand"), rows=F.array(row))))
    flat = artifacts.sample_rows(stored(spark, sf_dir, document, "sample_gen"))
    return flat.select(
        "table_name", F.col("row").getItem("name").alias("name"), F.col("row").getItem("kind").alias("kind")
    )


@query(
    "artifacts_configs",
    """
    SELECT p_name AS source_table, 'bronze.' || p_name AS target_table, 'csv' AS source_format, 'full' AS load_type,
      '/chk/' || p_partkey AS checkpoint_location, p_brand || ', ' || p_type AS columns FROM part WHERE p_size <> 13
    """,
)
def artifacts_configs(spark, sf_dir):
    config = _struct(
        source_table=F.col("p_name"), target_table=F.concat(F.lit("bronze."), F.col("p_name")), source_format="csv",
        load_type="full", checkpoint_location=F.concat(F.lit("/chk/"), F.col("p_partkey").cast("string")),
        selected_columns=F.array("p_brand", "p_type"),
    )
    flat = artifacts.ingestion_configs(stored(spark, sf_dir, _struct(ingestion_configs=F.array(config)), "ingestion_cfg_gen"))
    return flat.select("source_table", "target_table", "source_format", "load_type", "checkpoint_location", "columns")
