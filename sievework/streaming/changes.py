"""Change feeds: keep the latest row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sievework.sources import buckets as bucketed
from sievework.sources import sinks
from sievework.sources.sinks import latest_rows


def apply_changes(
    stream: DataFrame, table: str, keys: list[str], sequence: list[str], checkpoint: str, buckets: int = 0, **trigger
) -> StreamingQuery:
    """Keyed upsert of a change feed into a table in `buckets` hash buckets, of which a batch writes those it
    changes; or, with 0, into a versioned table that each batch writes whole.

    A batch is merged with the stored rows of its keys by sequence, so late and repeated changes
    do not undo newer ones, and a batch run again after a failure changes nothing.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        if buckets:
            bucketed.upsert(batch, table, keys, buckets, sequence, newest=True)
            return
        spark = batch.sparkSession
        newest = latest_rows(batch, keys, sequence).persist()
        try:
            known, merged = sinks.versions(spark, table), newest
            if known:
                stored = spark.table(f"{table}__v{known[-1]}")
                touched = stored.join(newest.select(*keys), keys, "left_semi")
                merged = latest_rows(touched.unionByName(newest), keys, sequence)
            sinks.upsert(merged, table, keys, sequence)
        finally:
            newest.unpersist()

    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    return writer.foreachBatch(load).trigger(**trigger).start()
