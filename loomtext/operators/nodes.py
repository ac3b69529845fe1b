"""Arrow-batched functions from a text to an array of node structs."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomtext.types import data_type


def node_function(parse: Callable[[str], object], ddl: str):
    """An Arrow function of the type ``ddl``; a null text gives null."""
    kind = data_type(ddl)
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else parse(t) for t in texts.to_pylist()], type=arrow)

    return run


def as_column(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column
