"""File streams whose files change shape: a schema log beside the checkpoint, and a column for what does not fit.

Files hold one JSON object per line. Lines are read as text and their fields as text, so no schema is fixed
before they are seen. A micro-batch first looks which names it holds. New ones get the narrowest type of
TYPES that all their values in the batch fit, and are added to the log as an evolution step: one JSON file
per step, numbered, with the batch that caused it; a step is written before the rows that need it, and a
batch that runs again writes the same step or finds it. A logged type is never changed: values that do not
fit it, objects with a name twice and lines that are no object go, as they came, into `_rescued` (a JSON
object by column name; a whole line under LINE), so nothing is lost and nothing fails.

Rows land in a folder per micro-batch, replaced if the batch runs again; `read` takes them together under
the whole log, columns that older batches lacked being NULL.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievework.session import cut

RESCUED, LINE = "_rescued", "_line"
#: Narrowest first; every text fits the last.
TYPES = ("boolean", "bigint", "double", "timestamp_ntz", "string")
STEP = "step INT, batch_id BIGINT, added ARRAY<STRUCT<name: STRING, type: STRING>>"


def steps(spark: SparkSession, log: str) -> DataFrame:
    """The evolution steps so far: step, batch_id, added (name, type)."""
    try:
        return spark.read.schema(STEP).json(f"{log}/step=*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # the folder comes with the first step
            raise
        return spark.createDataFrame([], STEP)


def columns(spark: SparkSession, log: str) -> dict[str, str]:
    """name -> type, in the order of the steps."""
    out: dict[str, str] = {}
    for r in steps(spark, log).orderBy("step").collect():
        for c in r["added"]:
            out.setdefault(c["name"], c["type"])
    return out


def _fits(value: Column, type_: str) -> Column:
    """The value in a type, NULL where it does not say the same there."""
    cast = value.try_cast(type_)
    if type_ == "boolean":
        return F.when(value.isin("true", "false"), cast)
    if type_ == "bigint":
        return F.when(cast.cast("string") == value, cast)
    if type_ == "double":
        return F.when(value.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), cast)
    if type_ == "timestamp_ntz":
        return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"), cast)
    return cast


def _parsed(lines: DataFrame) -> DataFrame:
    """value, fields: the names and values of each line, as texts; NULL for a line that is no object or has a name twice."""
    return lines.select("value", F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"}).alias("fields")).select(
        "value", F.when(F.size(F.array_distinct(F.map_keys("fields"))) == F.size(F.map_keys("fields")), F.col("fields")).alias("fields")
    )


def _new_columns(parsed: DataFrame, known: dict[str, str]) -> list[tuple[str, str]]:
    """Names the log lacks and the narrowest type that all their values fit: one row per name, combined in the tasks."""
    entries = parsed.select(F.explode("fields").alias("name", "v")).where(~F.col("name").isin(list(known)) if known else F.lit(True))
    fits = [F.bool_and(F.col("v").isNull() | _fits(F.col("v"), t).isNotNull()).alias(t) for t in TYPES[:-1]]
    found = entries.groupBy("name").agg(F.count("v").alias("values"), *fits).orderBy("name").collect()
    # a column that only holds null says nothing yet
    return [(r["name"], next((t for t in TYPES[:-1] if r[t]), TYPES[-1])) for r in found if r["values"]]


def shaped(parsed: DataFrame, known: dict[str, str]) -> DataFrame:
    """The columns of the log, and _rescued."""
    value = {n: F.col("fields")[n] for n in known}
    fitting = {n: _fits(value[n], t) for n, t in known.items()}
    lost = F.map_filter("fields", lambda k, v: v.isNotNull() & ~F.coalesce(
        F.element_at(F.create_map(*[x for n in known for x in (F.lit(n), fitting[n].isNotNull())]), k) if known else F.lit(False), F.lit(False)))
    rescued = F.when(F.col("fields").isNull(), F.to_json(F.create_map(F.lit(LINE), "value"))).when(F.size(lost) > 0, F.to_json(lost))
    return parsed.select(*[fitting[n].alias(n) for n in known], rescued.alias(RESCUED))


def load(spark: SparkSession, source: str, target: str, log: str, checkpoint: str, pattern: str = "*.json", **trigger) -> StreamingQuery:
    """Stream the files of a folder whose names match into `target`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        parsed = _parsed(batch)
        # Steps of this batch from an earlier attempt are taken as they are.
        done = {r["step"]: r for r in steps(spark, log).collect()}
        known = columns(spark, log)
        if batch_id not in {r["batch_id"] for r in done.values()}:
            new = _new_columns(cut(parsed), known)
            if new:
                number = max(done, default=-1) + 1
                row = json.dumps({"step": number, "batch_id": batch_id, "added": [{"name": n, "type": t} for n, t in new]})
                spark.createDataFrame([(row,)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{log}/step={number}")
                known = known | dict(new)
        shaped(parsed, known).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    lines = spark.readStream.option("pathGlobFilter", pattern).text(source)
    return lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**trigger).start()


def read(spark: SparkSession, target: str, log: str) -> DataFrame:
    """All rows under the whole log, with _rescued and batch_id."""
    named = ", ".join(f"`{n}` {t}" for n, t in [*columns(spark, log).items(), (RESCUED, "string"), ("batch_id", "bigint")])
    schema = spark.createDataFrame([], named).schema
    return spark.read.schema(schema).option("basePath", target).parquet(f"{target}/batch_id=*")
