"""HTTP/1.x messages in a text or binary column, as built-in expressions only.

A header name is anything but a colon and a value needs a byte, so text after the blank
line that looks like more headers is read as such; the rest is the body, byte for byte.
Version parts wrap at 256 and the status at 65536; a number beyond 64 bits is an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.operators.nodes import as_column
from loomtext.result import FAILURE, error_column

METHODS = ("OPTIONS", "GET", "POST", "PUT", "DELETE", "HEAD", "TRACE", "CONNECT", "PATCH")
_VERSION = r"HTTP/([0-9]++)\.([0-9]++)"
_HEADER = r"[^:]++: [^\r]++\r\n"
_TAIL = rf"\r\n((?:{_HEADER})*+)\r\n(.*+)\z"
_REQUEST = rf"(?s)\A({'|'.join(METHODS)}) ([^ ]++) {_VERSION}{_TAIL}"
_RESPONSE = rf"(?s)\A{_VERSION} ([0-9]++) ([^\r]++){_TAIL}"


def _wrapped(digits: Column, size: int, kind: str) -> Column:
    return (digits.try_cast("decimal(38,0)") % size).cast(kind)


def _fits(*digits: Column) -> Column:
    """Whether numbers are within unsigned 64 bits."""
    most = F.lit("18446744073709551615").cast("decimal(38,0)")
    good = F.lit(True)
    for d in digits:
        good = good & F.coalesce(d.try_cast("decimal(38,0)") <= most, F.lit(False))
    return good


def _headers(block: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(block, F.lit(rf"(?s){_HEADER}"), 0),
        lambda h: F.struct(F.regexp_extract(h, r"(?s)\A([^:]++): ", 1).alias("name"), F.regexp_extract(h, r"(?s)\A[^:]++: ([^\r]++)", 1).alias("value")),
    )


def _message(column: Column | str, pattern: str, binary: bool, expected: str, numbers: tuple[int, ...], fields) -> Column:
    given = as_column(column)
    # one character for each byte, so that a body of any bytes passes
    text = F.decode(given, "ISO-8859-1") if binary else given
    plain = (lambda c: F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")) if binary else (lambda c: c)
    raw = (lambda c: F.encode(c, "ISO-8859-1")) if binary else (lambda c: F.encode(c, "UTF-8"))
    group = lambda k: F.regexp_extract(text, pattern, k)
    matched, fits = text.rlike(pattern), _fits(*map(group, numbers))
    good = matched & fits
    value = F.struct(*(c.alias(n) for n, c in fields(group, plain, raw)))
    error = F.when(~matched, error_column(FAILURE, expected)).when(~fits, error_column(FAILURE, "number out of range"))
    return F.when(text.isNotNull(), F.struct(good.alias("ok"), F.when(good, value).alias("val"), error.alias("error")))


def http_request(column: Column | str, *, binary: bool = False) -> Column:
    """``struct<ok, val struct<method, uri, version, headers, body>, error>``."""

    def fields(g, plain, raw):
        version = F.struct(_wrapped(g(3), 256, "smallint").alias("major"), _wrapped(g(4), 256, "smallint").alias("minor"))
        headers = F.transform(_headers(g(5)), lambda h: F.struct(plain(h["name"]).alias("name"), plain(h["value"]).alias("value")))
        return [("method", g(1)), ("uri", plain(g(2))), ("version", version), ("headers", headers), ("body", raw(g(6)))]

    return _message(column, _REQUEST, binary, "expected an HTTP request", (3, 4), fields)


def http_response(column: Column | str, *, binary: bool = False) -> Column:
    """``struct<ok, val struct<version, status_code, status, headers, body>, error>``."""

    def fields(g, plain, raw):
        version = F.struct(_wrapped(g(1), 256, "smallint").alias("major"), _wrapped(g(2), 256, "smallint").alias("minor"))
        headers = F.transform(_headers(g(5)), lambda h: F.struct(plain(h["name"]).alias("name"), plain(h["value"]).alias("value")))
        return [("version", version), ("status_code", _wrapped(g(3), 65536, "int")), ("status", plain(g(4))), ("headers", headers), ("body", raw(g(6)))]

    return _message(column, _RESPONSE, binary, "expected an HTTP response", (1, 2, 3), fields)
