"""What a parse returns: a value or a located error, as data.

``parse_column`` gives ``struct<ok, val, rest, error>``; ``error`` is null where the parse
succeeded.  A null input gives a null struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAILURE, INCOMPLETE, SYNTAX = "ParsingFailure", "ParsingIncomplete", "SyntaxError"
PERMISSIVE, FAILFAST, DROPMALFORMED = "PERMISSIVE", "FAILFAST", "DROPMALFORMED"

ERROR = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("line", T.LongType()),
        T.StructField("col", T.LongType()),
        T.StructField("record", T.LongType()),
    ]
)


def result_type(value: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("val", value), T.StructField("rest", T.StringType()), T.StructField("error", ERROR)])


def error_column(kind: str, message, *, line=None, col=None, record=None) -> Column:
    """An error struct; arguments may be columns or plain values."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(kind).alias("kind"), as_column(message).cast("string").alias("message"),
        as_column(line).cast("bigint").alias("line"), as_column(col).cast("bigint").alias("col"), as_column(record).cast("bigint").alias("record"),
    )


def error_row(kind: str, message: str, line: int | None = None, col: int | None = None, record: int | None = None) -> dict:
    return {"kind": kind, "message": message, "line": line, "col": col, "record": record}


def position(text: str, at: int) -> tuple[int, int]:
    """One-based line and column of a place in a text."""
    start = text.rfind("\n", 0, at) + 1
    return text.count("\n", 0, at) + 1, at - start + 1


def with_mode(df: DataFrame, result: str, mode: str = PERMISSIVE) -> DataFrame:
    """Apply a mode to a result column: keep errors as data, drop bad rows, or fail the job at the first one."""
    bad = F.col(f"{result}.error").isNotNull()
    if mode == PERMISSIVE:
        return df
    if mode == DROPMALFORMED:
        return df.where(~F.coalesce(bad, F.lit(False)))
    if mode == FAILFAST:
        said = F.concat_ws(": ", F.col(f"{result}.error.kind"), F.col(f"{result}.error.message"))
        return df.where(F.when(bad, F.raise_error(said).cast("boolean")).otherwise(True))
    raise ValueError(f"unknown mode {mode!r}")
