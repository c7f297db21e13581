"""The programs of a corpus as one table of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tidy(c: Column | str) -> Column:
    """Trimmed of white space and lower-cased."""
    return F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^\s+|\s+$", ""))


def programs(cases: DataFrame, problems: DataFrame) -> DataFrame:
    """record_kind, key, text, part, hint, family, ast of all cases and problems.

    ``part`` numbers the kinds; records of different parts are never compared. Rows without a
    key are no records. Repeated rows of a key stay here and count once in every result.
    """
    a = cases.select(
        F.lit("case").alias("record_kind"), F.col("case_id").alias("key"), F.col("broken").alias("text"), F.lit(0).alias("part"),
        tidy("split_hint").alias("hint"), F.col("source").alias("family"), F.lit(None).cast("string").alias("ast"),
    )
    b = problems.select(
        F.lit("problem").alias("record_kind"), F.col("id").alias("key"), F.col("reference_source").alias("text"), F.lit(1).alias("part"),
        tidy("split_hint").alias("hint"), F.col("family_id").alias("family"), F.lower("normalized_ast_sha256").alias("ast"),
    )
    return a.unionByName(b).where(F.col("key").isNotNull())
