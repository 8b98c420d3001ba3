"""The corpus pipeline: documents go through the stages in order, each stage's rows written and read again.

All stages but the last keep the columns of `documents`. Toxic documents go; of each group of near copies
the smallest doc_id stays; documents that hold a benchmark window go; confirmed secrets are masked in the
texts of the documents that hold them (n_chars follows); what is left is packed into windows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import decontam, packing, secret_forest, simhash, toxicity
from sievework.llm.common import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    scorer = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score(F.col("text"), scorer) < toxicity.THRESHOLD)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links: shingles of 3 words, 3 bits at most."""
    return simhash.one_of_each(docs, max_bits=3, words=3, seed=42)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of 10 words of a benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, confirmed secrets replaced in their texts."""
    forest = secret_forest.train(secret_forest.generated_findings(spark))
    return secret_forest.redacted(docs, forest, path_col="source", length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, in windows of 1024 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("simhash", one_of_near_copies),
    ("decontamination", decontaminate),
    ("secrets", mask_secrets),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
