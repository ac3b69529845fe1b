"""Spark types from their short text form, without a running session."""

from __future__ import annotations

import re

from pyspark.sql import types as T

_SIMPLE = {
    "string": T.StringType, "binary": T.BinaryType, "boolean": T.BooleanType, "smallint": T.ShortType, "int": T.IntegerType, "bigint": T.LongType, "float": T.FloatType, "double": T.DoubleType,
}
_TOKEN = re.compile(r"\s*(struct<|array<|decimal\(\d+,\s*\d+\)|\w+|[<>,:])")


def data_type(text: str | T.DataType) -> T.DataType:
    """``struct<a: int, b: array<string>>``, ``decimal(20,0)`` and the plain names."""
    if isinstance(text, T.DataType):
        return text
    tokens = _TOKEN.findall(text)

    def read(i: int) -> tuple[T.DataType, int]:
        token = tokens[i]
        if token == "array<":
            inner, i = read(i + 1)
            return T.ArrayType(inner), i + 1
        if token == "struct<":
            fields, i = [], i + 1
            while tokens[i] != ">":
                if tokens[i] == ",":
                    i += 1
                name = tokens[i]
                kind, i = read(i + 2)
                fields.append(T.StructField(name, kind))
            return T.StructType(fields), i + 1
        if token.startswith("decimal("):
            precision, scale = map(int, re.findall(r"\d+", token))
            return T.DecimalType(precision, scale), i + 1
        if token not in _SIMPLE:
            raise ValueError(f"unknown type {token!r} in {text!r}")
        return _SIMPLE[token](), i + 1

    return read(0)[0]
