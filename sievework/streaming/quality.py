"""Quality checks on streams: windowed counts, duplicate keys, bad rows set aside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievework.operators.checks import Rule
from sievework.plans.suite import quarantine
from sievework.session import cut
from sievework.sources import buckets as bucketed


def event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Watermarks need a TIMESTAMP; zone-less columns are read in the session's zone."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def windowed_counts(
    stream: DataFrame, time: str, groups: list[str], checked: list[str], window: str = "1 day", delay: str = "1 hour"
) -> DataFrame:
    """Rows and NULLs per tumbling window and group. State lives until the watermark passes."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in checked]
    counted = event_time(stream, time, delay).groupBy(F.window(time, window), *groups).agg(F.count("*").alias("rows"), *nulls)
    return counted.select(F.col("window.start").alias("window_start"), *groups, "rows", *[f"null_{c}" for c in checked])


def first_rows(stream: DataFrame, time: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """First row per key within the watermark."""
    return event_time(stream, time, delay).dropDuplicatesWithinWatermark(keys)


def write_first_rows(
    stream: DataFrame, time: str, keys: list[str], order: list[str], path: str, seen: str, buckets: int, checkpoint: str,
    delay: str | None = None, **trigger,
) -> StreamingQuery:
    """The first row per key (by `order`) of each key not seen before, a folder of `path` per micro-batch.

    A micro-batch is first combined per key inside each task, so a key with a third of its rows reaches the
    shuffle as one row a task, and then held against the keys seen, kept with their time in table `seen`, in
    hash buckets of which a batch reads and writes those it falls into. With `delay`, rows older than the
    newest time by more than that are late and left out, and their keys are forgotten when their bucket is
    written. Keys a batch has put down itself do not count as seen, so a batch that runs again after a
    failure gives the same folder and state.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        known = spark.table(seen) if spark.catalog.tableExists(seen) else None
        before = None if known is None else known.where(F.col("batch_id") != batch_id)
        if delay is not None and before is not None:
            newest = before.agg(F.max("at")).first()[0]
            if newest is not None:
                batch = batch.where(F.col(time).cast("timestamp") >= F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}"))
        first = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
        one = cut(first.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in batch.columns]))
        fresh = one
        if before is not None:
            same = F.lit(True)
            for k in keys:
                same = same & F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}"))
            fresh = cut(one.alias("n").join(before.alias("o"), same, "left_anti"))
        fresh.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        marks = fresh.select(*keys, F.col(time).cast("timestamp").alias("at"), F.lit(batch_id).cast("long").alias("batch_id"))

        def fold(old: DataFrame, new: DataFrame) -> DataFrame:
            kept = old.where(F.col("batch_id") != batch_id).unionByName(new)
            if delay is None:
                return kept
            horizon = kept.agg(F.max("at").alias("newest")).select((F.col("newest") - F.expr(f"INTERVAL {delay}")).alias("horizon"))
            return kept.join(F.broadcast(horizon), F.col("at") >= F.col("horizon")).drop("horizon")

        bucketed.rewrite(marks, seen, keys, buckets, fold, marks.schema)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(load).trigger(**trigger).start()


def per_batch(path: str) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch to its own folder; a batch run again after a failure replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def write_updates(counts: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Updated groups of every micro-batch, so state can be dropped behind the watermark."""
    writer = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(per_batch(path)).trigger(**trigger).start()


def read_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last update of each group."""
    rows = spark.read.option("basePath", path).parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("u"))
    return last.select(*keys, *[F.col(f"u.{c}").alias(c) for c in rest])


def write_split(
    stream: DataFrame, rules: list[Rule], path: str, checkpoint: str, as_of: str | None = None, **trigger
) -> StreamingQuery:
    """Good and bad rows to two folders below `path`, in one pass over each micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        marked = quarantine(batch, rules, as_of)
        verdict: Column = F.when(F.size("broken_rules") > 0, "bad").otherwise("good")
        marked.withColumn("verdict", verdict).write.mode("overwrite").partitionBy("verdict").parquet(
            f"{path}/batch_id={batch_id}"
        )

    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(**trigger).start()
