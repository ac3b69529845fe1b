"""Whole files as rows, and tables back to files; only Spark opens a path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str, *, pattern: str | None = None) -> DataFrame:
    """(path, text): one row a file, every character kept (the text reader drops a last line end); null if it is no UTF-8."""
    return read_binary(spark, path, pattern=pattern).select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def read_binary(spark: SparkSession, path: str, *, pattern: str | None = None) -> DataFrame:
    """(path, content binary): one row a file, any bytes."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "content")


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """Parquet, one folder for each value of the partition columns."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
