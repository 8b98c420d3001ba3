"""Run-log analytics: cost, totals, repeats, recent history, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# US dollars per million tokens in and out, by a part of the model name.
RATES = {"claude": (15.0, 75.0)}
DEFAULT_RATES = (5.0, 15.0)
KEPT_RUNS = 20
SHOWN_RUNS = 10


def cost(model: Column, prompt: Column, completion: Column) -> Column:
    """Cost of one run, to 6 places."""

    def rate(side: int) -> Column:
        out = F.lit(DEFAULT_RATES[side])
        for part, rates in RATES.items():
            out = F.when(F.lower(model).contains(part), F.lit(rates[side])).otherwise(out)
        return out

    return F.bround(prompt / F.lit(1e6) * rate(0) + completion / F.lit(1e6) * rate(1), 6)


def with_cost(runs: DataFrame) -> DataFrame:
    return runs.withColumn("cost_usd", cost(F.col("model"), F.col("token_prompt"), F.col("token_completion")))


def totals(runs: DataFrame) -> DataFrame:
    """Tokens and cost per agent, and of the whole log where agent_id is NULL."""
    exact = F.col("cost_usd").cast("decimal(20,6)")
    return runs.rollup("agent_id").agg(
        F.count("*").alias("runs"),
        F.sum("token_prompt").alias("token_prompt"),
        F.sum("token_completion").alias("token_completion"),
        F.sum(F.col("token_prompt") + F.col("token_completion")).alias("token_total"),
        F.sum(exact).cast("double").alias("cost_usd"),
    )


def content_key(*parts: str) -> Column:
    """md5 over the parts as one JSON object with sorted names."""
    return F.md5(F.to_json(F.struct(*sorted(parts)), {"ignoreNullFields": "false"}))


def first_results(runs: DataFrame, parts: list[str], order: list[str], result: str) -> DataFrame:
    """One row per content key: the first result, and how many runs it serves."""
    return runs.groupBy(content_key(*parts).alias("content_key")).agg(
        F.min_by(result, F.struct(*order)).alias(result), F.count("*").alias("runs")
    )


def latest(runs: DataFrame, n: int, order: list[Column], by: str | None = None) -> DataFrame:
    """The n newest runs, per agent or of the whole log. Each task keeps n before the shuffle."""
    if by is None:
        return runs.orderBy(*order).limit(n)
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return runs.withColumn("place", place).filter(F.col("place") <= n)


def status_summary(runs: DataFrame, order: list[str]) -> DataFrame:
    """Runs and durations by agent and status, and the error of the last run in `order` that has one."""
    at = F.when(F.col("error").isNotNull(), F.struct(*order))
    return runs.groupBy("agent_id", "status").agg(
        F.count("*").alias("runs"),
        F.min("duration_s").alias("min_duration_s"),
        F.avg("duration_s").alias("avg_duration_s"),
        F.max("duration_s").alias("max_duration_s"),
        F.max_by("error", at).alias("last_error"),
    )


def registered(
    registry: DataFrame, agent_type: str | None = None, category: str | None = None, enabled_only: bool = True
) -> DataFrame:
    """Registry rows by type, category and enabled flag."""
    out = registry.filter("enabled") if enabled_only else registry
    if agent_type is not None:
        out = out.filter(F.col("type") == agent_type)
    if category is not None:
        out = out.filter(F.col("category") == category)
    return out
