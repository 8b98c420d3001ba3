"""Ingestion jobs: files into tables, whole, in increments, or as a stream."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sievework.sources import files, sinks
from sievework.streaming.changes import apply_changes

LOAD_TYPES = ("full", "incremental", "streaming", "merge")


@dataclass(frozen=True)
class IngestSpec:
    table: str
    schema: T.StructType | None = None
    load_type: str = "incremental"
    source_format: str = "parquet"
    source_path: str = ""
    target_schema: str = "bronze"
    checkpoint_base: str = ""
    columns: list[str] = field(default_factory=list)
    record_source: str = ""
    load_date: str | None = None
    keys: list[str] = field(default_factory=list)
    sequence: list[str] = field(default_factory=list)
    buckets: int = 0
    options: dict[str, str] = field(default_factory=dict)
    trigger: str = "1 minute"

    def __post_init__(self) -> None:
        if not self.checkpoint_base:
            raise ValueError("name a shared folder for checkpoints (checkpoint_base)")

    @property
    def path(self) -> str:
        return self.source_path or f"{self.checkpoint_base}/source/{self.table}/"

    @property
    def checkpoint(self) -> str:
        return f"{self.checkpoint_base}/{self.table}/checkpoint"

    @property
    def schema_path(self) -> str:
        return f"{self.checkpoint_base}/{self.table}/schema"

    @property
    def target(self) -> str:
        return f"{self.target_schema}.{self.table}"


def describe(specs: list[IngestSpec], spark: SparkSession) -> DataFrame:
    """One configuration row per table."""
    rows = [
        (
            s.table, s.target, s.path, s.load_type, s.source_format, s.checkpoint, s.schema_path,
            s.columns or (s.schema.names if s.schema else []),
            sinks.ddl(s.target, s.schema) if s.schema else None,
        )
        for s in specs
    ]
    return spark.createDataFrame(
        rows,
        "source_table STRING, target_table STRING, source_path STRING, load_type STRING, source_format STRING, "
        "checkpoint_location STRING, schema_location STRING, selected_columns ARRAY<STRING>, target_ddl STRING",
    )


def stored_schema(spark: SparkSession, spec: IngestSpec) -> T.StructType:
    """The given schema, else the one kept beside the checkpoint, else that of the files; then kept.

    Later runs use the kept schema, so a new file cannot change column types between runs.
    """
    kept = _kept(spark, spec.schema_path)
    if kept is not None and spec.schema is None:
        return T.StructType.fromJson(json.loads(kept))
    schema = spec.schema or files.read(spark, spec.path, spec.source_format, **spec.options).schema
    if kept is None:
        spark.createDataFrame([(schema.json(),)], "value STRING").coalesce(1).write.mode("overwrite").text(spec.schema_path)
    return schema


def _kept(spark: SparkSession, path: str) -> str | None:
    """The line kept at a path, None where nothing is."""
    try:
        row = spark.read.text(path).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row and row[0]


def _with_provenance(df: DataFrame, spec: IngestSpec) -> DataFrame:
    out = df.select(*spec.columns) if spec.columns else df
    if spec.load_date is not None:
        out = out.withColumn("load_date", F.lit(spec.load_date).cast("timestamp_ntz"))
    if spec.record_source:
        out = out.withColumn("record_source", F.lit(f"{spec.record_source}.{spec.table}"))
    return out


def run(spark: SparkSession, spec: IngestSpec) -> StreamingQuery | None:
    """Start the load. Only a streaming load returns before it is done.

    incremental and merge remember loaded files in the checkpoint: a rerun loads new files only. A merge with
    `buckets` rewrites only the hash buckets in which a row changes.
    """
    if spec.load_type not in LOAD_TYPES:
        raise ValueError(f"unknown load type '{spec.load_type}', choose from {list(LOAD_TYPES)}")
    if spec.load_type == "full":
        df = files.read(spark, spec.path, spec.source_format, spec.schema, **spec.options)
        sinks.full_refresh(_with_provenance(df, spec), spec.target)
        return None

    source = files.stream(spark, spec.path, spec.source_format, stored_schema(spark, spec), **spec.options)
    rows = _with_provenance(source, spec)
    if spec.load_type == "merge":
        if not spec.keys or not spec.sequence:
            raise ValueError("a merge load needs keys, and a sequence that says which row of a key is the last")
        query = apply_changes(rows, spec.target, spec.keys, spec.sequence, spec.checkpoint, spec.buckets, availableNow=True)
    else:
        trigger = {"availableNow": True} if spec.load_type == "incremental" else {"processingTime": spec.trigger}
        writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", spec.checkpoint)
        query = writer.trigger(**trigger).toTable(spec.target)
    if spec.load_type == "streaming":
        return query
    query.awaitTermination()
    return None


def run_all(spark: SparkSession, specs: list[IngestSpec]) -> list[StreamingQuery]:
    """One load per table; the running streams are returned."""
    started = [run(spark, spec) for spec in specs]
    return [q for q in started if q is not None]
