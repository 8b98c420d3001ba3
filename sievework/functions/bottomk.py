"""Samples by the smallest hashes: the same values or rows whatever the partitioning, without shuffling what is sampled.

A hash of seed and text orders all values; a sample is the k with the smallest hashes. Most rows are ruled
out in the scan by a threshold that leaves a few times k, so each task hands on a handful of values. The
threshold is a guess from a count. A sample is taken only where enough hashes lie below it; else it is raised,
to no threshold at all in the end, so the result does not depend on the guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.session import cut

SPARE, RAISE = 4, 8
#: Hex digits that order values; the whole text breaks ties.
DIGITS = 16


def seeded(text: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), text).cast("binary"))


def _below(mark: Column, share: float) -> Column:
    """Whether a hash is among the given share of all hashes."""
    return F.lit(True) if share >= 1 else F.substring(mark, 1, DIGITS) < F.lit(f"{int(share * 16**DIGITS):0{DIGITS}x}")


def values(df: DataFrame, texts: dict[str, Column], distinct: dict[str, int], k: int, seed: int = 0) -> DataFrame:
    """name, sample: for each named text column the k distinct values with the smallest hashes, in their order.

    distinct: about how many there are. Every task gives one row, whatever it reads; NULL is no value.
    """
    spark = df.sparkSession
    out = spark.createDataFrame([], "name string, sample array<string>")
    shares = {n: min(1.0, SPARE * k / max(distinct.get(n, 0), 1)) for n in texts}
    while shares:
        parts = []
        for name, share in shares.items():
            mark = seeded(texts[name], seed)
            kept = F.collect_set(F.when(texts[name].isNotNull() & _below(mark, share), F.struct(mark.alias("mark"), texts[name].alias("value"))))
            parts.append(F.struct(F.lit(name).alias("name"), F.slice(F.array_sort(kept), 1, k)["value"].alias("sample")))
        found = cut(df.agg(F.array(*parts).alias("all")).select(F.inline("all")))
        short = {r["name"] for r in found.select("name", F.size("sample").alias("n")).collect() if r["n"] < k and shares[r["name"]] < 1}
        out = out.unionByName(found.where(~F.col("name").isin(list(short))) if short else found)
        shares = {n: min(1.0, shares[n] * RAISE) for n in shares if n in short}
    return out


def rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The n rows with the smallest hashes (all, if there are fewer). Rows that repeat share a hash: they are in together."""
    mark = seeded(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), seed)
    total = df.count()
    share = min(1.0, (n + 6 * n**0.5 + 20) / max(total, 1))
    marked = df.withColumn("_mark", mark)
    while share < 1 and marked.where(_below(F.col("_mark"), share)).count() < min(n, total):
        share = min(1.0, share * RAISE)
    return marked.where(_below(F.col("_mark"), share)).orderBy("_mark").limit(n).drop("_mark")
