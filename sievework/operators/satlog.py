"""Satellites that do not depend on the order of their loads: a log of runs behind the history.

A log row is a run: the load dates of a parent, next to each other in one chunk of time, at which its
attributes were the same. It holds the first and the last of them, all of them with what decides between
rows of one date (`seen`), the hash_diff and the attributes. Rows that repeat their predecessor are not in a
satellite, but their dates are in the log; so when a late row with other attributes falls between them, its
run splits and the later repeat comes back as a row of its own.

A load folds its rows into the pieces (parent, chunk) they fall into and leaves the others; `load` keeps the
log in hash buckets of the parent and writes only the touched ones. Choose the chunk (a date_trunc unit) so
that a parent has a bounded number of load dates in it: a long history is folded by many tasks.

Of several rows of one parent and date the one with the greatest tie break stays, then record source, then
hash_diff, in whatever load it comes; a load that runs twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.hashing import hash_diff, hash_key
from sievework.operators import vault
from sievework.sources import buckets as bucketed

#: What a log row has besides the parent and the attributes.
OWN = ["chunk", "first_seen", "last_seen", "seen", "hash_diff"]


def observe(
    df: DataFrame,
    parent_hk: str,
    keys: list[str],
    load_date: Column,
    attributes: list[str],
    record_source: str,
    tie_break: list[str],
    chunk: str = "month",
    algo: str = "sha256",
    parent_key: Column | None = None,
) -> DataFrame:
    """The rows of one load: per parent and load date the one with the greatest tie break.

    parent_hk, chunk, load_date, rank (tie break, record source, hash_diff), hash_diff, attributes. Rows are
    reduced on native keys first. `parent_key` replaces the hash of `keys`, for satellites on links. Rows
    without any key are dropped.
    """
    known = df.filter(F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull())
    last = known.groupBy(*keys, load_date.cast("timestamp_ntz").alias("load_date")).agg(
        F.max(F.struct(F.struct(*tie_break).alias("tie"), F.struct(*attributes).alias("a"))).alias("last")
    )
    parent = hash_key(*[F.col(k) for k in keys], algo=algo) if parent_key is None else parent_key
    hashed = last.select(
        parent.alias(parent_hk), F.date_trunc(chunk, F.col("load_date")).cast("timestamp_ntz").alias("chunk"), "load_date",
        F.struct(F.col("last.tie").alias("tie"), F.lit(record_source).alias("record_source")).alias("rank"),
        hash_diff(*[F.col(f"last.a.{c}") for c in attributes], algo=algo).alias("hash_diff"),
        *[F.col(f"last.a.{c}").alias(c) for c in attributes],
    )
    return _one_per_date(hashed, parent_hk, attributes) if any(isinstance(df.schema[k].dataType, T.StringType) for k in keys) else hashed


def _one_per_date(rows: DataFrame, parent_hk: str, attributes: list[str]) -> DataFrame:
    """Of each parent and load date the greatest (rank, hash_diff). Spellings of a key, and loads, meet here."""
    order = F.struct("rank", "hash_diff")
    best = rows.groupBy(parent_hk, "chunk", "load_date").agg(F.max_by(F.struct("rank", "hash_diff", *attributes), order).alias("r"))
    return best.select(parent_hk, "chunk", "load_date", "r.*")


def runs(rows: DataFrame, parent_hk: str, attributes: list[str]) -> DataFrame:
    """Log rows from one row per parent and load date."""
    piece = Window.partitionBy(parent_hk, "chunk").orderBy("load_date")
    turns = F.when(F.col("hash_diff").eqNullSafe(F.lag("hash_diff").over(piece)), 0).otherwise(1)
    numbered = rows.withColumn("_turns", turns).withColumn("_run", F.sum("_turns").over(piece.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        numbered.groupBy(parent_hk, "chunk", "_run")
        .agg(
            F.min("load_date").alias("first_seen"), F.max("load_date").alias("last_seen"),
            F.array_sort(F.collect_list(F.struct("load_date", "rank"))).alias("seen"),
            F.first("hash_diff").alias("hash_diff"), *[F.first(F.col(c)).alias(c) for c in attributes],
        )
        .select(parent_hk, *OWN, *attributes)
    )


def fold(log: DataFrame, arrived: DataFrame, parent_hk: str) -> DataFrame:
    """The log after rows of `observe`, in any order. Pieces without a new row pass as they are."""
    attributes = [c for c in log.columns if c not in (parent_hk, *OWN)]
    piece = [parent_hk, "chunk"]
    touched = arrived.select(*piece)
    old = log.join(touched, piece, "left_semi").select(*piece, F.inline("seen"), "hash_diff", *attributes)
    columns = [*piece, "load_date", "rank", "hash_diff", *attributes]
    merged = _one_per_date(old.select(*columns).unionByName(arrived.select(*columns)), parent_hk, attributes)
    return log.join(touched, piece, "left_anti").unionByName(runs(merged, parent_hk, attributes))


def load(arrived: DataFrame, table: str, parent_hk: str, buckets: int) -> list[int]:
    """Fold rows of `observe` into a stored log; the hash buckets it wrote."""
    attributes = [c for c in arrived.columns if c not in (parent_hk, "chunk", "load_date", "rank", "hash_diff")]
    empty = runs(arrived, parent_hk, attributes)
    return bucketed.rewrite(arrived, table, [parent_hk], buckets, lambda log, new: fold(log, new, parent_hk), empty.schema)


def satellite(log: DataFrame, parent_hk: str, chunk: str | None = "month") -> DataFrame:
    """The satellite: the first date of each run that is not its predecessor's repeat, ended by the next.

    Runs that go on from one chunk to the next are one row. `chunk` cuts the runs of a parent as `vault.history` does.
    """
    staged = log.select(
        parent_hk, F.col("first_seen").alias("load_date"), F.col("seen")[0]["rank"]["record_source"].alias("record_source"), "hash_diff",
        *[c for c in log.columns if c not in (parent_hk, *OWN)],
    )
    return vault.history(staged, parent_hk, chunk)
