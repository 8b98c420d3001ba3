"""The register of queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievework.session import scratch
from sievework.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query '{key}' is registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {name: table(spark, sf_dir, name) for name in names}


def scratch_schema(spark: SparkSession) -> tuple[str, str]:
    """(schema name, folder) of a new schema in the shared folder."""
    folder = scratch(spark, "schema")
    name = "sw_" + folder.rpartition("-")[2]
    sinks.create_schema(spark, name, folder)
    return name, folder


def stream_place(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, dict[str, str]]:
    """Folder and options that stream one table, be it a single file or a folder of files."""
    place = f"{sf_dir}/{name}.parquet"
    if all(f.rstrip("/").endswith(f"/{name}.parquet") for f in spark.read.parquet(place).inputFiles()):
        return sf_dir, {"pathGlobFilter": f"{name}.parquet"}
    return place, {}
