"""JSON-lines tables: strict and lenient scans with an ordinal, and sinks that never lose rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from mendframe.functions.text import lenient_json


def scan_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON-lines file or folder with ``file`` and ``ordinal``; blank lines are skipped, a bad line fails the job.

    The ordinal rises in the order of lines within a file, which is all that "first" and "last" need; it
    has gaps. Files are split for reading, so no task reads a whole large file.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") * (1 << 20)).alias("_start"), F.monotonically_increasing_id().alias("_id"))
    kept = raw.where(F.trim("value") != "")
    parsed = kept.withColumn("_row", F.from_json("value", schema, {"mode": "FAILFAST"}))
    return parsed.select("_row.*", "file", F.struct("_start", "_id").alias("ordinal"))


def scan_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects among the lines of a text, parsed; lines that are none are skipped."""
    return lenient_json(spark.read.text(path), "value", schema).select("value.*")


def one_or_fail(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, filtered at the scan; no such row fails when the result is read."""
    hit = df.where(F.col(key) == F.lit(value))
    n = hit.agg(F.count(F.lit(1)).alias("_n"))
    checked = n.select(F.when(F.col("_n") == 0, F.raise_error(F.lit(f"no row with {key} = {value}"))).otherwise(F.lit(True)).cast("boolean").alias("_ok"))
    return hit.withColumn("_", F.lit(0)).join(F.broadcast(checked.withColumn("_", F.lit(0))), "_").where("_ok").drop("_ok", "_")  # one row is broadcast


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path, ignoreNullFields=True)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=True)


def create(df: DataFrame, path: str) -> None:
    """Write once; an existing path is an error and stays as it is."""
    df.write.mode("errorifexists").json(path, ignoreNullFields=True)


def manifest(df: DataFrame, path: str) -> None:
    """A one-row table as one JSON file."""
    df.limit(1).coalesce(1).write.mode("overwrite").json(path)


def append_with_state(rows: DataFrame, state: DataFrame, rows_path: str, state_path: str) -> None:
    """Rows first, then the state that says they are there: a crash between both repeats rows, never loses them.

    Readers drop repeats by key, so writing again after a crash changes nothing.
    """
    append(rows, rows_path)
    append(state, state_path)
