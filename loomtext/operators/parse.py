"""Run a grammar over a column.

Regular grammars become built-in expressions inside whole-stage code generation; others
run as one Arrow-batched function.  Both give the same struct.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomtext.operators.grammar import Abort, Fail, Grammar, NotRegular
from loomtext.result import FAILURE, INCOMPLETE, error_column, error_row, position, result_type

MATCHED, WHOLE = False, True


def run(grammar: Grammar, text: str, whole: bool) -> dict:
    """One result, as a dict of the struct's fields."""
    try:
        r = grammar.match(text, 0)
    except Abort as stop:
        r = Fail(0, str(stop))
    except RecursionError:
        r = Fail(0, "nested too deeply")
    if isinstance(r, Fail):
        return {"ok": False, "val": None, "rest": None, "error": error_row(FAILURE, r.message, *position(text, r.at))}
    value, end = r
    if whole and end < len(text):
        return {"ok": False, "val": None, "rest": text[end:], "error": error_row(INCOMPLETE, "input was left over", *position(text, end))}
    return {"ok": True, "val": value, "rest": text[end:], "error": None}


def _python(column: Column, grammar: Grammar, whole: bool) -> Column:
    kind = result_type(grammar.type)
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def parse(texts: pa.Array) -> pa.Array:
        # each text of a batch is parsed once, however often it stands there
        places: dict[str | None, int] = {}
        at = [places.setdefault(t, len(places)) for t in texts.to_pylist()]
        parsed = pa.array([None if t is None else run(grammar, t, whole) for t in places], type=arrow)
        return parsed if len(places) == len(at) else parsed.take(pa.array(at, type=pa.int32()))

    return parse(column)


def _sql(column: Column, grammar: Grammar, whole: bool) -> Column:
    r = grammar.regex()
    pattern = f"(?s)\\A{r.pattern}(.*+)\\z"
    group = lambda k: F.regexp_extract(column, pattern, k)
    found, left = column.rlike(f"(?s)\\A{r.pattern}"), group(r.groups + 1)
    valid = F.lit(True) if r.valid is None else F.coalesce(r.valid(group), F.lit(False))
    bad = ~found | ~valid

    def error_at(place: Column, kind: str, message) -> Column:
        before = F.substring(column, F.lit(1), place)
        line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
        return error_column(kind, message, line=line, col=F.length(F.substring_index(before, "\n", -1)) + 1)

    # looked for only where the parse failed
    place, message = grammar.locate(column)
    error = F.when(bad, error_at(F.coalesce(place, F.lit(0)), FAILURE, message))
    good = ~bad
    if whole:
        good = good & (left == "")
        error = error.when(left != "", error_at(F.length(column) - F.length(left), INCOMPLETE, "input was left over"))
    result = F.struct(good.alias("ok"), F.when(good, r.value(group)).alias("val"), F.when(found & valid, left).alias("rest"), error.alias("error"))
    return F.when(column.isNotNull(), result)


def _parse(column, grammar: Grammar, whole: bool, engine: str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    if engine not in ("auto", "sql", "python"):
        raise ValueError(f"unknown engine {engine!r}")
    if engine != "python":
        try:
            return _sql(column, grammar, whole)
        except NotRegular:
            if engine == "sql":
                raise
    return _python(column, grammar, whole)


def parse_column(column: Column | str, grammar: Grammar, *, engine: str = "auto") -> Column:
    """The whole text must match: ``struct<ok, val, rest, error>``; what is left over is ``ParsingIncomplete``."""
    return _parse(column, grammar, WHOLE, engine)


def parse_prefix(column: Column | str, grammar: Grammar, *, engine: str = "auto") -> Column:
    """A prefix must match; ``rest`` is what follows it."""
    return _parse(column, grammar, MATCHED, engine)


def parse_bytes(column: Column | str, grammar: Grammar, *, whole: bool = True) -> Column:
    """As ``parse_column`` over a binary column, one character of the grammar for each byte."""
    column = F.col(column) if isinstance(column, str) else column
    return _parse(F.decode(column, "ISO-8859-1"), grammar, whole, "auto")


def could_start(column: Column | str, grammar: Grammar) -> Column:
    """A cheap test that every match passes, to filter rows before a costly parse."""
    column = F.col(column) if isinstance(column, str) else column
    first = grammar.first()
    return F.lit(True) if first is None else column.rlike(f"\\A[{first}]")
