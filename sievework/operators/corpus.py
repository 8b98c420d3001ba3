"""Text corpora: paragraph chunks, keyword scores, top passages, token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import CHARS_PER_TOKEN, SPACE, occurrences, strip, tokens

BLANK_LINE = rf"\n{SPACE}*\n"

# Fixed values
STOP_WORDS = ["the", "a", "an", "and", "or", "is", "in", "of", "to", "for"]
EDGE_PUNCTUATION = """.,;:()'\""""


def chunks(
    docs: DataFrame, chunk_tokens: int = 500, separator: str = BLANK_LINE, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Paragraphs packed greedily into passages: doc_id, chunk_no, chunk.

    Each passage starts with its source. A paragraph longer than a passage stays whole. The fold
    over a document's paragraphs carries lengths and passage starts only; texts are joined once.
    """
    limit = chunk_tokens * CHARS_PER_TOKEN
    source = F.concat(F.lit("[Source: "), F.col(doc_id).cast("string"), F.lit("]"))
    head = F.length(source) + 1

    paragraphs = F.filter(F.transform(F.split(text, separator, -1), strip), lambda p: F.length(p) > 0)
    prepared = docs.select(F.col(doc_id).alias("doc_id"), source.alias("_source"), head.alias("_head"), paragraphs.alias("_paras"))

    # state: length of the open passage, index of the first paragraph of each closed one, position
    state = F.struct(
        F.col("_head").alias("used"), F.array(F.lit(0)).alias("starts"), F.lit(0).alias("at")
    )

    def pack(acc: Column, size: Column) -> Column:
        fits = acc["used"] + size + 2 <= limit
        return F.struct(
            F.when(fits, acc["used"] + size + 2).otherwise(F.col("_head") + size + 2).alias("used"),
            F.when(fits, acc["starts"]).otherwise(F.array_append(acc["starts"], acc["at"])).alias("starts"),
            (acc["at"] + 1).alias("at"),
        )

    sizes = F.transform("_paras", lambda p: F.length(p))
    starts = F.aggregate(sizes, state, pack)["starts"]
    packed = prepared.withColumn("_starts", starts)

    def passage(start: Column, no: Column) -> Column:
        until = F.coalesce(F.try_element_at("_starts", no + 2), F.size("_paras"))
        body = F.array_join(F.slice("_paras", start + 1, until - start), "\n\n")
        return F.when(until > start, F.concat("_source", F.lit("\n"), body)).otherwise(F.col("_source"))

    return packed.select("doc_id", F.posexplode(F.transform("_starts", passage)).alias("chunk_no", "chunk"))


def score(lowered: Column, keywords: list[str]) -> Column:
    """Occurrences of the keywords in lower-cased text; 0 without keywords."""
    total = F.lit(0).cast("bigint")
    for word in [k.lower() for k in keywords if k]:
        total = total + occurrences(lowered, word)
    return total


def top_k(chunk_rows: DataFrame, queries: dict[str, list[str]], k: int) -> DataFrame:
    """The k best passages per query, case ignored, ties in document order.

    queries are keyword lists of a few questions, part of the plan. Each task keeps its own k best
    before the shuffle.
    """
    lowered = F.col("_lowered")
    scores = F.array(
        *[F.struct(F.lit(q).alias("query"), score(lowered, words).alias("score")) for q, words in queries.items()]
    )
    prepared = chunk_rows.select("doc_id", "chunk_no", "chunk", F.lower("chunk").alias("_lowered"))
    scored = prepared.select("doc_id", "chunk_no", "chunk", F.explode(scores).alias("s")).select(
        "s.query", "s.score", "doc_id", "chunk_no", "chunk"
    )
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id", "chunk_no"))
    return scored.withColumn("place", place).filter(F.col("place") <= k)


def fit_budget(
    ranked: DataFrame, max_tokens: int, reserved: int = 0, k: int | None = None
) -> DataFrame:
    """The first passages per query (of the first k) whose tokens fit the budget; stops at the first that does not."""
    running = Window.partitionBy("query").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return (
        (ranked if k is None else ranked.filter(F.col("place") <= k))
        .withColumn("tokens", tokens(F.col("chunk")))
        .withColumn("used", F.sum("tokens").over(running))
        .filter(F.col("used") <= max_tokens - reserved)
    )


def over_budget(df: DataFrame, text: str, limit: int) -> DataFrame:
    return df.withColumn("tokens", tokens(F.col(text))).withColumn("over_budget", F.col("tokens") > limit)


def context_words(text: Column) -> Column:
    """Distinct words of a text, without edge punctuation, short words and stop words."""
    words = F.split(strip(F.lower(text)), f"{SPACE}+")
    clean = F.transform(words, lambda w: F.btrim(w, F.lit(EDGE_PUNCTUATION)))
    return F.array_distinct(F.filter(clean, lambda w: (F.length(w) > 3) & ~w.isin(STOP_WORDS)))


def keywords(contexts: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct keywords per key, from free text."""
    return contexts.select(key, F.explode(context_words(F.col(text))).alias("keyword")).distinct()


def metadata_keywords(columns: DataFrame, job: str) -> DataFrame:
    """Distinct keywords from table names, column names and the words of a job's name."""
    words = F.concat(
        F.array(F.lower("table_name"), F.lower("name")), F.array(*[F.lit(w) for w in job.split("_")])
    )
    return columns.select(F.explode(words).alias("keyword")).distinct()
