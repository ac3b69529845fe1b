"""From result columns to node rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def node_rows(df: DataFrame, result: Column, keys: Sequence[str], *, nodes: str = "nodes") -> DataFrame:
    """``keys``, the fields of each node, and ``error``: a document that failed is one row of kind ``error``.

    A null text, and a document without nodes, gives no rows.
    """
    parsed = df.select(*keys, result.alias("__parsed"))
    wrapped = F.when(
        F.col("__parsed.error").isNull(), F.transform(F.col(f"__parsed.{nodes}"), lambda n: F.struct(n.alias("n"), F.col("__parsed.error").alias("error")))
    ).otherwise(F.array(F.struct(F.get(F.col(f"__parsed.{nodes}"), F.lit(0)).alias("n"), F.col("__parsed.error").alias("error"))))
    rows = parsed.select(*keys, F.explode(wrapped).alias("__row"))
    kind = F.when(F.col("__row.error").isNotNull(), F.lit("error")).otherwise(F.col("__row.n.kind"))
    names = rows.schema["__row"].dataType["n"].dataType.names
    return rows.select(*keys, *((kind if n == "kind" else F.col(f"__row.n.{n}")).alias(n) for n in names), F.col("__row.error").alias("error"))
