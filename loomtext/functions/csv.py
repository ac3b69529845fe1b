"""CSV (RFC 4180) in a text column: raw records, and records decoded by a fixed schema.

The record grammar is regular, so splitting and decoding are built-in expressions.  An
empty text is one record with one empty field, a final line end adds another; CRLF and LF
end a record, a lone CR does not; nothing is repaired.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators.grammar import NotRegular, Regex
from loomtext.operators.nodes import as_column
from loomtext.result import FAILURE, INCOMPLETE, SYNTAX, error_column

#: (unquoted characters, characters inside quotes); strict data is printable ASCII without tabs.
_CHARSETS = {"ascii": (r"[\x20-\x7E&&[^\",]]", r"[\x20-\x7E\r\n&&[^\"]]"), "utf8": (r"[^\",\r\n]", r"[^\"]")}
_END = r"\r?\n"


def _field(charset: str) -> str:
    plain, inside = _CHARSETS[charset]
    return f'(?>"(?:""|{inside})*+"|{plain}*+)'


def _record(charset: str) -> str:
    return f"(?>{_field(charset)}(?:,{_field(charset)})*+)"


def _fields(record: Column, charset: str) -> Column:
    """Fields of one record: unquoted, doubled quotes undone."""
    found = F.regexp_extract_all(record, F.lit(rf"(?:\A|(?<=,)){_field(charset)}"), 0)
    inner = lambda f: F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))
    return F.transform(found, lambda f: F.when(f.startswith('"'), inner(f)).otherwise(f))


def csv_records(column: Column | str, *, charset: str = "ascii") -> Column:
    """``struct<records array<array<string>>, error>``; a text that is no CSV as a whole has a SyntaxError with what is left."""
    text = as_column(column)
    record = _record(charset)
    whole = rf"(?s)\A{record}(?:{_END}{record})*+(.*+)\z"
    left = F.regexp_extract(text, whole, 1)
    records = F.transform(F.regexp_extract_all(text, F.lit(rf"(?:\A|(?<=\n)){record}(?=\r?\n|\z)"), 0), lambda r: _fields(r, charset))
    good = left == ""
    return F.when(text.isNotNull(), F.struct(F.when(good, records).alias("records"), F.when(~good, error_column(SYNTAX, left)).alias("error")))


def csv_record(column: Column | str, *, charset: str = "ascii") -> Column:
    """``struct<fields, error>`` of a text that is one record."""
    text = as_column(column)
    left = F.regexp_extract(text, rf"(?s)\A{_record(charset)}(.*+)\z", 1)
    return F.when(text.isNotNull(), F.struct(F.when(left == "", _fields(text, charset)).alias("fields"), F.when(left != "", error_column(SYNTAX, left)).alias("error")))


class Field:
    """How one field decodes: ``value(text)`` is null where it does not."""

    def __init__(self, name: str, value, expected: str):
        self.name, self.value, self.expected = name, value, expected


def string(name: str) -> Field:
    return Field(name, lambda c: c, "text")


def u64(name: str) -> Field:
    number = lambda c: F.when(c.rlike(r"\A[0-9]+\z"), c.try_cast("decimal(38,0)"))
    return Field(name, lambda c: F.when(number(c) <= F.lit("18446744073709551615").cast("decimal(38,0)"), number(c)).cast("decimal(20,0)"), "an unsigned 64-bit number")


def f64(name: str) -> Field:
    shape = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
    return Field(name, lambda c: F.when(c.rlike(shape), c.try_cast("double")), "a number")


def parsed(name: str, grammar) -> Field:
    """A field read by a regular grammar."""
    regex: Regex = grammar.regex()
    if regex.soft:
        raise NotRegular("decode the field with flatten's expression instead")

    def value(c: Column) -> Column:
        ok = c.rlike(rf"(?s)\A{regex.pattern}\z")
        valid = F.lit(True) if regex.valid is None else regex.valid(regex.of(c))
        return F.when(ok & valid, regex.value(regex.of(c)))

    return Field(name, value, "text of the field's grammar")


def decode_record(fields: Column, spec: Sequence[Field], *, record=None) -> Column:
    """``struct<val, error>`` of one record: every field must decode and none may be left."""
    get = lambda i: F.get(fields, F.lit(i))
    value = F.struct(*(f.value(get(i)).alias(f.name) for i, f in enumerate(spec)))
    fail = lambda kind, message: error_column(kind, message, record=record)
    error = F.when(F.lit(False), fail(FAILURE, ""))
    for i, f in enumerate(spec):  # in the order of the fields, so that the first failure is reported
        error = error.when(F.size(fields) <= i, fail(FAILURE, "expected another field but the record has no more"))
        error = error.when(f.value(get(i)).isNull(), fail(FAILURE, F.concat(F.lit(f"field {f.name}: expected {f.expected}, found "), get(i))))
    error = error.when(F.size(fields) > len(spec), fail(INCOMPLETE, F.concat_ws(", ", F.slice(fields, len(spec) + 1, F.greatest(F.size(fields), F.lit(len(spec) + 1))))))
    return F.struct(F.when(error.isNull(), value).alias("val"), error.alias("error"))


def decode_rows(df: DataFrame, column: str, spec: Sequence[Field], *, charset: str = "ascii") -> DataFrame:
    """PERMISSIVE: one row a record with ``record_no`` (from 1), ``val`` and ``error``; a text that is no CSV is one row with its error."""
    split = df.withColumn("__csv", csv_records(column, charset=charset))
    rows = split.select(*df.columns, F.col("__csv.error").alias("__bad"), F.posexplode_outer("__csv.records").alias("__no", "__fields"))
    number = (F.col("__no") + 1).cast("bigint")
    decoded = decode_record(F.col("__fields"), spec, record=number)
    some = F.col("__fields").isNotNull()
    return rows.select(*df.columns, number.alias("record_no"), F.when(some, decoded["val"]).alias("val"), F.coalesce(F.when(some, decoded["error"]), F.col("__bad")).alias("error"))


def decode_text(column: Column | str, spec: Sequence[Field], *, charset: str = "ascii") -> Column:
    """The whole text or its first error: ``struct<val array<struct>, error>``, without a shuffle."""
    split = csv_records(column, charset=charset)
    each = F.transform(split["records"], lambda r, i: decode_record(r, spec, record=i + 1))
    first = F.get(F.filter(each, lambda x: x["error"].isNotNull()), F.lit(0))["error"]
    error = F.coalesce(split["error"], first)
    return F.struct(F.when(error.isNull(), F.transform(each, lambda x: x["val"])).alias("val"), error.alias("error"))
