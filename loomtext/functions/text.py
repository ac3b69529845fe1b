"""Bytes to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.operators.nodes import as_column


def text_from_utf8(column: Column | str, *, strict: bool = True) -> Column:
    """A binary column as text.  Invalid UTF-8 fails the job, or is null with ``strict=False``."""
    text = as_column(column).cast("string")
    return F.validate_utf8(text) if strict else F.try_validate_utf8(text)


def text_from_ascii(column: Column | str, *, strict: bool = True) -> Column:
    """The character of a number from 0 to 127.  Any other number fails the job, or is null with ``strict=False``."""
    n = as_column(column)
    other = F.raise_error(F.concat(n.cast("string"), F.lit(" is no ASCII code"))).cast("string") if strict else F.lit(None).cast("string")
    return F.when(n.isNull(), None).when((n >= 0) & (n < 128), F.char(n)).otherwise(other)
