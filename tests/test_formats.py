"""CSV and HTTP: the grammar's cases and each quirk."""

import pytest
from pyspark.sql import functions as F

from loomtext.functions import csv as C
from loomtext.functions import http_request, http_response
from loomtext.functions.registry import csv_render, csv_split

MOVIES = "Airplane!,1980,\"Robert Hays,Julie Hagerty\"\nCaddyshack,1980,\"Chevy Chase,Rodney Dangerfield,Ted Knight,Michael O'Keefe,Bill Murray\""
CSV_CASES = [
    ("", [[""]], None),
    ("a\n", [["a"], [""]], None),
    ("\n\na", [[""], [""], ["a"]], None),
    ("a,b\r\nc,d", [["a", "b"], ["c", "d"]], None),
    ("a\rb", None, "\rb"),
    ('"a""b","x\ny",', [['a"b', "x\ny", ""]], None),
    ('"a"b', None, "b"),
    ('"abc', None, '"abc'),
    ("a\tb", None, "\tb"),
    ("é", None, "é"),
    (",", [["", ""]], None),
    ('"a,\r\n""",b\n"",', [['a,\r\n"', "b"], ["", ""]], None),
    (MOVIES, [["Airplane!", "1980", "Robert Hays,Julie Hagerty"], ["Caddyshack", "1980", "Chevy Chase,Rodney Dangerfield,Ted Knight,Michael O'Keefe,Bill Murray"]], None),
]


def test_csv_split(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CSV_CASES)], "i int, t string")
    for r in df.select("i", "t", C.csv_records("t").alias("r")).collect():
        _, records, left = CSV_CASES[r["i"]]
        assert (r["r"]["records"], r["r"]["error"] and r["r"]["error"]["message"]) == (records, left), r
        plain, error = csv_split(r["t"])
        assert (plain, error and error["message"]) == (records, left), r
    assert df.select(C.csv_records(F.lit(None).cast("string")).alias("r")).first()["r"] is None
    assert df.limit(1).select(C.csv_records(F.lit("é\tb"), charset="utf8")["records"].alias("r")).first()["r"] == [["é\tb"]]
    assert csv_split(csv_render([["a,b", 'c"d'], ["", "e\nf"]]))[0] == [["a,b", 'c"d'], ["", "e\nf"]]


def test_csv_long_text_does_not_recurse(spark):
    text = ("abc," * 50 + '"d ""e"""\n') * 2000
    got = spark.createDataFrame([(text,)], "t string").select(F.size(C.csv_records("t")["records"]).alias("n")).first()["n"]
    assert got == 2001


SPEC = (C.string("name"), C.u64("n"))


@pytest.mark.parametrize(
    "text, kind, record",
    [("a", "ParsingFailure", 1), ("a,1,c", "ParsingIncomplete", 1), ("a,1\nb,x", "ParsingFailure", 2), ("a,1\nb,18446744073709551616", "ParsingFailure", 2), ('"a"b', "SyntaxError", None), ("a,1\nb,2", None, None)],
)
def test_csv_decode(spark, text, kind, record):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(C.decode_text("t", SPEC).alias("r")).first()["r"]
    assert (got["error"] and (got["error"]["kind"], got["error"]["record"])) == (kind and (kind, record))
    assert (got["val"] is None) == (kind is not None)


def test_csv_rows_and_numbers(spark):
    df = spark.createDataFrame([(MOVIES,)], "t string")
    movies = C.decode_rows(df, "t", (C.string("title"), C.u64("year"), C.string("actors"))).orderBy("record_no").collect()
    assert [(r["record_no"], r["val"]["title"], int(r["val"]["year"]), len(r["val"]["actors"].split(","))) for r in movies] == [(1, "Airplane!", 1980, 2), (2, "Caddyshack", 1980, 5)]
    numbers = spark.createDataFrame([("1e5",), (".5",), ("5.",), (" 5",), ("1.5d",), ("x",), ("",)], "t string")
    decoded = [r["v"] for r in numbers.select(C.f64("v").value(F.col("t")).alias("v")).collect()]
    assert decoded == [1e5, 0.5, 5.0, None, None, None, None]


REQUEST = "GET /things?id=1 HTTP/1.1\r\nHost: bar.example\r\nAccept-Encoding: gzip, deflate\r\n\r\nHello, world!"
OPTIONS = "OPTIONS /resources/post-here/ HTTP/1.1\r\nHost: bar.example\r\nOrigin: https://foo.example\r\n\r\n"
RESPONSE = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX: a\r\nX: b\r\n\r\n<p>é</p>\r\n"


def test_http(spark):
    df = spark.createDataFrame([(REQUEST,)], "t string")
    v = df.select(http_request("t").alias("r")).first()["r"]["val"]
    assert (v["method"], v["uri"], v["version"]["major"], v["version"]["minor"], bytes(v["body"])) == ("GET", "/things?id=1", 1, 1, b"Hello, world!")
    assert [tuple(h) for h in v["headers"]] == [("Host", "bar.example"), ("Accept-Encoding", "gzip, deflate")]
    v = df.select(http_request(F.lit(OPTIONS)).alias("r")).first()["r"]["val"]
    assert v["method"] == "OPTIONS" and len(v["headers"]) == 2 and bytes(v["body"]) == b""
    for binary in (False, True):
        column = F.encode(F.lit(RESPONSE), "UTF-8") if binary else F.lit(RESPONSE)
        v = df.select(http_response(column, binary=binary).alias("r")).first()["r"]["val"]
        assert (v["status_code"], v["status"], bytes(v["body"]).decode()) == (200, "OK", "<p>é</p>\r\n")
        assert [tuple(h) for h in v["headers"]][1:] == [("X", "a"), ("X", "b")]


@pytest.mark.parametrize(
    "text", ["get / HTTP/1.1\r\n\r\n", "GET / HTTP/1.1\r\nX: \r\n\r\n", "GET / HTTP/1.1\n\n", "GET  HTTP/1.1\r\n\r\n", ""],
)
def test_http_refusals(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(http_request("t").alias("r")).first()["r"]
    assert not got["ok"] and got["error"]["kind"] == "ParsingFailure"


def test_http_quirks(spark):
    df = spark.range(1)
    # text after the blank line that reads like a header is one; numbers wrap
    v = df.select(http_request(F.lit("PUT /a HTTP/257.1\r\nA: b\r\n\r\nc: d\r\n\r\nrest")).alias("r")).first()["r"]["val"]
    assert [tuple(h) for h in v["headers"]] == [("A", "b"), ("\r\nc", "d")] and bytes(v["body"]) == b"rest" and v["version"]["major"] == 1
    assert df.select(http_response(F.lit("HTTP/1.1 65737 OK\r\n\r\n")).alias("r")).first()["r"]["val"]["status_code"] == 201
    assert not df.select(http_response(F.lit("HTTP/1.1 200 \r\n\r\n")).alias("r")).first()["r"]["ok"]
