"""File scans: parquet, csv, json, delta, avro, text corpora and run-result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions import bottomk

FORMATS = ("parquet", "delta", "csv", "json", "avro")
READ_OPTIONS = {"csv": {"header": "true", "sep": ","}, "json": {"multiLine": "false"}}


def check_format(fmt: str) -> str:
    fmt = fmt.lower()
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format '{fmt}', choose from {list(FORMATS)}")
    return fmt


def read(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None, **options: str
) -> DataFrame:
    """Read files of one format.

    Parquet, delta and avro carry their schema. csv and json are inferred as a convenience, which
    costs one more pass over the files; give `schema` for large inputs.
    """
    fmt = check_format(fmt)
    opts = {**READ_OPTIONS.get(fmt, {}), **options}
    if fmt == "csv" and schema is None:
        opts.setdefault("inferSchema", "true")
    reader = spark.read.format(fmt).options(**opts)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def table_name(path: str) -> str:
    """Last path part up to its first dot."""
    return path.rstrip("/").split("/")[-1].split(".")[0] or "file_table"


def table_name_of(path: Column, root: str) -> Column:
    """The same rule for files below a root that holds one file or folder per table."""
    below = root.split("://")[-1].rstrip("/")
    return F.regexp_extract(path, rf"\Q{below}\E/+([^/.]*)", 1)


def with_table_name(df: DataFrame, root: str, out: str = "table_name") -> DataFrame:
    return df.withColumn(out, table_name_of(F.col("_metadata.file_path"), root))


def sample_rows(df: DataFrame, rows: int, seed: int = 0) -> DataFrame:
    """So many rows, fixed by the seed: the same whatever the partitioning, ruled out in the scan."""
    return bottomk.rows(df, rows, seed)


def sample_share(df: DataFrame, key: Column, share: float, seed: int = 0) -> DataFrame:
    """A sample fixed by key and seed: the same rows whatever the partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), key.cast("string"))
    number = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return df.filter(number < F.lit(int(share * 2**32)))


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """One row per .md, .json or .txt file of a folder."""
    files = spark.read.option("pathGlobFilter", "*.{md,json,txt}").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text"))


RUN_RESULT = T.StructType(
    [
        T.StructField("agent_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField(
            "token_usage",
            T.StructType([T.StructField(n, T.LongType()) for n in ("prompt", "completion", "total")]),
        ),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("duration_s", T.DoubleType()),
        T.StructField("timestamp", T.StringType()),
    ]
)


def read_run_results(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Run results, one JSON document per line, or with `multi_line` per file (read by one task each); `output` is kept as JSON text, whether stored as text or as an object."""
    return spark.read.schema(RUN_RESULT).option("multiLine", multi_line).json(path)


def stream(
    spark: SparkSession, path: str, fmt: str, schema: T.StructType | str, **options: str
) -> DataFrame:
    """A file stream over a directory."""
    fmt = check_format(fmt)
    opts = {**READ_OPTIONS.get(fmt, {}), **options}
    return spark.readStream.format(fmt).schema(schema).options(**opts).load(path)
