"""Parse a stream: good rows to one sink, errors kept as rows in another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_stream(stream: DataFrame, result: Column, *, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(good rows with ``val``, bad rows with ``error``) of a result column over a stream or a table."""
    parsed = stream.select(*keep, result.alias("__r"))
    good = parsed.where(F.col("__r").isNotNull() & F.col("__r.error").isNull()).select(*keep, F.col("__r.val").alias("val"))
    bad = parsed.where(F.col("__r.error").isNotNull()).select(*keep, F.col("__r.error").alias("error"))
    return good, bad


def sum_by_window(rows: DataFrame, time: str, value: Column, *, every: str, late: str) -> DataFrame:
    """Sums of a parsed value in event-time windows; rows later than ``late`` behind the newest are left out of closed windows."""
    return rows.withWatermark(time, late).groupBy(F.window(time, every).alias("w")).agg(F.sum(value).alias("total"), F.count(value).alias("n"))
