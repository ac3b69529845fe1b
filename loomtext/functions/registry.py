"""SQL names: table functions ``csv_rows``, ``xml_nodes``, ``yaml_nodes``, ``md_blocks``, ``md_inlines``.

    SELECT d.id, n.* FROM docs d, LATERAL xml_nodes(d.text) n

Each gives the fields of its node struct and ``error``; a bad document is one row of kind
``error``.  ``md_debug``, ``md_render`` and ``yaml_debug`` are scalar functions.
"""

from __future__ import annotations

import csv as _csv
import io

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.functions import markdown, xml, yaml
from loomtext.functions.markdown import BLOCK, INLINE
from loomtext.result import ERROR, SYNTAX, error_row
from loomtext.types import data_type

#: One field or line end of a text; used with a scan that must cover the whole text.
_STRICT = set(map(chr, range(0x20, 0x7F))) | {"\r", "\n"}


def csv_split(text: str) -> tuple[list[list[str]] | None, dict | None]:
    """Records of a text by a plain scan; the same as ``csv_records``."""
    records, fields, at, size = [], [], 0, len(text)
    while True:
        if text.startswith('"', at):
            end = at + 1
            while end < size and (text[end] in _STRICT and text[end] != '"' or text.startswith('""', end)):
                end += 2 if text[end] == '"' else 1
            closed = text.startswith('"', end)
            fields.append(text[at + 1 : end].replace('""', '"') if closed else "")
            at = end + 1 if closed else at
        else:
            end = at
            while end < size and text[end] in _STRICT and text[end] not in '",\r\n':
                end += 1
            fields.append(text[at:end])
            at = end
        if text.startswith(",", at):
            at += 1
            continue
        records.append(fields)
        fields = []
        step = 2 if text.startswith("\r\n", at) else 1 if text.startswith("\n", at) else 0
        if not step:
            return (records, None) if at == size else (None, error_row(SYNTAX, text[at:]))
        at += step


def csv_render(records: list[list[str]]) -> str:
    """The text of records, quoted where needed, without a final line end."""
    out = io.StringIO()
    _csv.writer(out, lineterminator="\n").writerows(records)
    return out.getvalue().removesuffix("\n")


def _with_error(node: str) -> T.StructType:
    return T.StructType([*data_type(node).fields, T.StructField("error", ERROR)])


def _table_function(parse, part: str, node: str):
    shape = _with_error(node)
    names = shape.names[:-1]

    class Nodes:
        def eval(self, text: str):
            if text is None:
                return
            out = parse(text)
            if out["error"] is not None:
                yield (*("error" if n == "kind" else None for n in names), tuple(out["error"].values()))
                return
            for row in out[part]:
                yield (*(row[n] if n != "attrs" or row[n] is None else [tuple(a.values()) for a in row[n]] for n in names), None)

    return F.udtf(Nodes, returnType=shape)


def _markdown_row(text: str) -> dict:
    found, error = markdown._guarded(text, markdown.rows)
    blocks, inner = found or (None, None)
    return {"blocks": blocks, "inlines": inner, "error": error}


class _CsvRows:
    def eval(self, text: str):
        if text is None:
            return
        records, error = csv_split(text)
        if error is not None:
            yield None, None, tuple(error.values())
            return
        for i, fields in enumerate(records, 1):
            yield i, fields, None


def register(spark: SparkSession) -> None:
    """Make the SQL names known to a session."""
    csv_shape = T.StructType([T.StructField("record_no", T.LongType()), T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("error", ERROR)])
    spark.udtf.register("csv_rows", F.udtf(_CsvRows, returnType=csv_shape))
    spark.udtf.register("xml_nodes", _table_function(xml.parse_document, "nodes", xml.NODE))
    spark.udtf.register("yaml_nodes", _table_function(yaml._parse_row, "nodes", yaml.NODE))
    spark.udtf.register("md_blocks", _table_function(_markdown_row, "blocks", BLOCK))
    spark.udtf.register("md_inlines", _table_function(_markdown_row, "inlines", INLINE))
    for name, function in (("md_debug", markdown._DEBUG), ("md_render", markdown._RENDER), ("yaml_debug", yaml._DEBUG)):
        spark.udf.register(name, function)
