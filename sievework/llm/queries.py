"""The registered queries of the operators, each over its whole table, and the SQL some must agree with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import decontam, divergence, hilbert, line_dedup, packing, periodic, pivots, prefix_counts, secret_forest, simhash, token_files, toxicity, warc
from sievework.llm.common import shared_folder, stored

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
END_ID = 0
TOKEN_LIMIT = 4096
SHARDS = 16


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_hilbert_shards")
def hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = hilbert.shard(
        docs, ["lang", "source", "n_chars", "doc_id"], SHARDS, law="bytes",
        size=F.coalesce(F.octet_length("text"), F.lit(0)) + 1,
        carry={"text_crc32": F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))},
    )
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "cell",
    )


@query("op2_token_files")
def token_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, folder = public_tokenizers.path(BYTE_BPE), shared_folder(spark, "tokens")
    parts = token_files.write(table(spark, sf_dir, "documents"), folder, path, END_ID)
    return token_files.read(spark, folder, [p for p, _, _ in parts], path)


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM p),
d AS (
  SELECT *, list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, CAST(5 * g + 1 AS INT), 5))::INT >> s) & 31), 1)
  ), 'string_agg', '')), 'string_agg', '') AS digest FROM f
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, true AS complete
FROM d
"""


@query("op3_warc", WARC_SQL)
def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = warc.write(table(spark, sf_dir, "pages"), shared_folder(spark, "warc"), least_bytes=0)
    return warc.reassemble(warc.read_records(spark, paths))


@query("op4_packing")
def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), packing.WINDOW, END_ID)


@query("op5_toxicity")
def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scorer = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return docs.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), toxicity.score(F.col("text"), scorer).alias("score")
    ).withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


@query("op6_pivot_index")
def pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"), least_cosine=0.9)


@query("op7_simhash_groups")
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.grouped(table(spark, sf_dir, "documents"), max_bits=3, words=3, seed=42)
    return groups.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS g
  FROM i, unnest(range(1, 2 + len(w) - least(len(w), 10))) t(k) WHERE len(w) > 0
), lengths AS (SELECT DISTINCT n FROM grams), known AS (SELECT DISTINCT n, g FROM grams),
runs AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS g FROM d, lengths, unnest(range(1, len(w) - n + 2)) t(k)
), hits AS (SELECT doc_id, k, n, g FROM runs JOIN known USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(k, k + n)) t(p) GROUP BY doc_id),
items AS (SELECT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits JOIN grams USING (n, g) GROUP BY ALL),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM items GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


@query("op8_decontamination", DECONTAMINATION_SQL)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontam.items_digest(F.col("items")).alias("items_sha256"), "contaminated")


@query("op9_secret_forest")
def secret_forest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secret_forest.train(secret_forest.generated_findings(spark))
    return secret_forest.findings(table(spark, sf_dir, "documents"), forest, path_col="source")


@query("op10_prefix_counts")
def prefix_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, and how much of each text a budget of TOKEN_LIMIT tokens keeps: both from the stored counts."""
    counts = stored(prefix_counts.prefix_table(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE)), "prefix-counts")
    over = (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit")
    return prefix_counts.within_budget(counts, TOKEN_LIMIT, ["n_bytes", "n_tokens"]).select("doc_id", "n_bytes", "n_tokens", over, "kept_chars", "kept_tokens")


LINE_SQL = r"""
WITH l AS (
  SELECT doc_id, k, s[k] AS line, translate(trim(s[k], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) t(k)
), m AS (SELECT *, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) < doc_id AS dropped FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op11_line_dedup", LINE_SQL)
def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.with_keep(table(spark, sf_dir, "documents"))
    kept = line_dedup.kept_text(F.col("text"), F.col("keep"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256"))


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (SELECT doc_id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 10),
langs AS (SELECT lang, count(term) AS v, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
met AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(m.n, 0)::HUGEINT AS n, sum(coalesce(m.n, 0)) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) g JOIN kept k USING (lang) LEFT JOIN met m USING (lang, source, term)
), p AS (SELECT lang, source, term, n, 1 + 1000000000 * (n + 2) // (c.total + 2 * v) AS p FROM cells c JOIN langs USING (lang)),
q AS (SELECT lang, term, 1 + 1000000000 * (n::HUGEINT + 2) // (total + 2 * v) AS q FROM kept JOIN langs USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM (SELECT DISTINCT lang, source FROM d) a JOIN (SELECT DISTINCT lang, source FROM d) b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, 'pair' AS part FROM pairs UNION ALL BY NAME SELECT *, 'term' AS part FROM terms
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM ranked QUALIFY part = 'pair' OR rank <= 10
"""


@query("op12_divergence", DIVERGENCE_SQL)
def divergence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def with_periods(text: Column, doc_id: Column) -> Column:
    """The text, with a repeated stretch put into those whose id's checksum is a multiple of 10."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    g = F.floor(h / 10)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    turns = (F.lit(3) + F.pmod(g, F.lit(8))).cast("int")
    p = F.floor((n - a) / turns).cast("int") + 1
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), turns)), F.lit(1), n - a)
    return F.when(F.pmod(h, F.lit(10)) == 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")).otherwise(text)


@query("op13_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", with_periods(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic.with_runs(docs)
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.call_function("div", 1000 * best["length"], best["period"]).alias("exponent_milli"),
        F.sha2(periodic.listed(F.col("runs")), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
