"""Combinators: sample grammars, committed choice, and both engines against each other."""

import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import could_start, parse_bytes, parse_column, parse_prefix
from loomtext.operators import grammar as g
from loomtext.operators.parse import run
from loomtext.result import DROPMALFORMED, FAILFAST, with_mode

COLOR = g.one_of([g.lit("green").map(lambda v: "Green", "string", lambda c: F.lit("Green")), g.lit("red"), g.lit("blue")])
REQUIREMENT = g.record().keep("count", g.digits()).skip(g.lit(" ")).keep("color", COLOR)
GAME = g.record().skip(g.lit("Game ")).keep("id", g.digits()).skip(g.lit(": ")).keep("sets", REQUIREMENT.sep_by(g.lit(", ")).sep_by(g.lit("; ")))
AFTER_COLON = g.record().skip(g.take_until(":")).skip(g.lit(":")).keep("n", g.digits()).map(lambda v: v["n"], "decimal(20,0)", lambda c: c["n"])
NOT_A_DIGIT = g.take_while("0-9").skip_then(g.rest())
BOOLS = g.one_of([g.lit("true").map(lambda v: True, "boolean", lambda c: F.lit(True)), g.lit("false").map(lambda v: False, "boolean", lambda c: F.lit(False))])


def one(spark, text, grammar, prefix=False, engine="auto"):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select((parse_prefix if prefix else parse_column)("t", grammar, engine=engine).alias("r")).first()["r"]


CASES = [
    ("# H\nR", g.take_until("\n"), True, "# H"),
    ("", g.take_until("\n"), True, None),
    ("as\ndf", g.take_while("^\n"), True, "as"),
    ("a", g.any_char(), False, "a"),
    ("$", g.any_char(), False, "$"),
    ("consumes all the input", g.rest(), False, "consumes all the input"),
    ("123", g.digits(), False, 123),
    ("green", COLOR, False, "Green"),
    ("1,2,3", g.digits().sep_by(g.lit(",")), False, [1, 2, 3]),
    ("", g.digits().sep_by(g.lit(",")), False, []),
    ("1,2,", g.digits().sep_by(g.lit(",")), False, None),
    ("Foo", g.lit("Foo"), False, "Foo"),
    ("Bar", g.lit("Foo"), False, None),
    ("ignore preceding text:123", AFTER_COLON, False, 123),
    ("0123456789876543210TEXT", NOT_A_DIGIT, False, "TEXT"),
    ("0", g.one("0-9"), False, "0"),
    ("*", g.one("0-9"), False, None),
    ("@", g.lit("@"), True, "@"),
    ("$", g.lit("@"), True, None),
    ("0", g.digit(), False, 0),
    ("not a digit", g.digit(), False, None),
    ("0123", g.digits(), False, 123),
    ("not a digit", g.digits(), False, None),
    ("true", BOOLS, False, True),
    ("false", BOOLS, False, False),
    ("not a bool", BOOLS, False, None),
    ("x", g.const("v").then_skip(g.lit("x")), False, "v"),
    ("x", g.fail("never"), False, None),
    ("(7)", g.digits().between(g.lit("("), g.lit(")")), False, 7),
    ("aab", g.lit("a").many().then_skip(g.lit("b")), False, ["a", "a"]),
    ("b", g.lit("a").one_or_more(), False, None),
    ("ab", g.map2(g.lit("a"), g.lit("b"), lambda a, b: b + a, "string", lambda a, b: F.concat(b, a)), False, "ba"),
    ("abc", g.map3(g.lit("a"), g.lit("b"), g.lit("c"), lambda a, b, c: c + b + a, "string", lambda a, b, c: F.concat(c, b, a)), False, "cba"),
    ("18446744073709551615", g.digits(), False, (1 << 64) - 1),
    ("18446744073709551616", g.digits(), False, None),
    ("300", g.digits().flatten(lambda v: v if v < 256 else None, "int", lambda c: F.when(c < 256, c).cast("int")), False, None),
    ("b", g.lit("a").maybe().skip_then(g.lit("b")), False, "b"),
    ("", g.lit("a").maybe(), False, None),
]


@pytest.mark.parametrize("engine", ["sql", "python"])
def test_samples(spark, engine):
    for text, grammar, prefix, want in CASES:
        got = one(spark, text, grammar, prefix, engine)
        assert got["val"] == want, (text, engine, got)
        assert got["ok"] == (want is not None or (text == "" and isinstance(grammar, g.Maybe))), (text, engine, got)


@pytest.mark.parametrize("engine", ["sql", "python"])
def test_game(spark, engine):
    got = one(spark, "Game 1: 3 blue, 4 red; 1 red, 2 green, 6 blue; 2 green", GAME, engine=engine) if engine == "python" or GAME.regular else None
    assert got["val"]["id"] == 1
    assert [[(int(r["count"]), r["color"]) for r in s] for s in got["val"]["sets"]] == [[(3, "blue"), (4, "red")], [(1, "red"), (2, "Green"), (6, "blue")], [(2, "Green")]]


@pytest.mark.parametrize("engine", ["sql", "python"])
def test_a_choice_is_never_retried(spark, engine):
    grammar = g.alt(g.lit("a"), g.lit("ab")).skip_then(g.lit("c"))
    assert not one(spark, "abc", grammar, engine=engine)["ok"]
    assert one(spark, "ac", grammar, engine=engine)["ok"]


@pytest.mark.parametrize("engine", ["sql", "python"])
def test_leftover_has_its_place(spark, engine):
    got = one(spark, "1,2\n,3", g.digits().sep_by1(g.lit(",")), engine=engine)
    assert (got["error"]["kind"], got["rest"], got["error"]["line"], got["error"]["col"]) == ("ParsingIncomplete", "\n,3", 1, 4)


def test_a_repetition_must_consume():
    for bad in (lambda: g.take_while("a").many(), lambda: g.rest().one_or_more(), lambda: g.lit("").sep_by(g.take_while(","))):
        with pytest.raises(g.GrammarError):
            bad()
    with pytest.raises(g.GrammarError):
        g.record().keep("a", g.lit("x")).keep("a", g.lit("y"))
    with pytest.raises(g.GrammarError):
        g.alt(g.lit("x"), g.digits())


def test_recursive_and_custom_grammars_run_in_python(spark):
    nested = g.lazy(lambda: g.alt(g.record().skip(g.lit("(")).keep("n", nested).skip(g.lit(")")).map(lambda v: v["n"] + 1, "bigint"), g.const(0, "bigint")), "bigint")
    assert not nested.regular
    assert one(spark, "((()))", nested)["val"] == 3
    assert not one(spark, "(" * 100_000, nested)["ok"]
    counted = g.digits().and_then(lambda n: g.chars("a", least=int(n), most=int(n)), "string")
    assert one(spark, "3aaa", counted)["val"] == "aaa" and not one(spark, "3aa", counted)["ok"]
    applied = g.apply(g.lit("+").map(lambda v: (lambda x: x + 1), "string"), g.digits(), "decimal(20,0)")
    assert one(spark, "+4", applied)["val"] == 5
    with pytest.raises(g.NotRegular):
        parse_column("t", nested, engine="sql")


def test_bytes_are_matched_one_by_one(spark):
    df = spark.createDataFrame([(bytearray("é".encode()),)], "b binary")
    got = df.select(parse_bytes("b", g.any_char(), whole=False).alias("r")).first()["r"]
    assert got["ok"] and len(got["rest"]) == 1


def test_null_in_null_out_and_modes(spark):
    df = spark.createDataFrame([("1",), (None,), ("x",)], "t string").select(parse_column("t", g.digits()).alias("r"))
    assert [r["r"] is None for r in df.collect()] == [False, True, False]
    assert with_mode(df, "r", DROPMALFORMED).count() == 2
    with pytest.raises(Exception, match="ParsingFailure"):
        with_mode(df, "r", FAILFAST).collect()
    starts = spark.createDataFrame([("1",), ("x",)], "t string").select(could_start("t", g.digits()).alias("c")).collect()
    assert [r["c"] for r in starts] == [True, False]


def _random_grammar(rng, depth=3):
    leaves = [g.lit("a"), g.lit("ab"), g.lit("b"), g.chars("ab"), g.chars("bc", least=0), g.one("abc"), g.take_until("b")]
    if depth == 0:
        return rng.choice(leaves).map(lambda v: v, "string", lambda c: c)
    kind = rng.randrange(6)
    sub = lambda: _random_grammar(rng, depth - 1)
    text = lambda p, fn, sql: p.map(fn, "string", sql)
    try:
        if kind == 0:
            return g.alt(sub(), sub())
        if kind == 1:
            return g.map2(sub(), sub(), lambda a, b: f"<{a},{b}>", "string", lambda a, b: F.concat(F.lit("<"), a, F.lit(","), b, F.lit(">")))
        if kind == 2:
            return text(sub().many(), lambda v: "|".join(v), lambda c: F.array_join(c, "|"))
        if kind == 3:
            return text(sub().sep_by1(g.lit("c")), lambda v: "/".join(v), lambda c: F.array_join(c, "/"))
        if kind == 4:
            return text(sub().maybe(), lambda v: v if v is not None else "none", lambda c: F.coalesce(c, F.lit("none")))
        return text(sub().sep_by(g.lit("b")), lambda v: "-".join(v), lambda c: F.array_join(c, "-"))
    except g.GrammarError:
        return _random_grammar(rng, 0)


def test_both_engines_agree_on_random_grammars(spark):
    rng = random.Random(5)
    texts = ["", *("".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(120))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").cache()
    compared = 0
    for _ in range(24):
        grammar = _random_grammar(rng)
        if not grammar.regular:
            continue
        compared += 1
        engines = [parse("t", grammar, engine=e).alias(f"{e}{i}") for i, parse in enumerate((parse_column, parse_prefix)) for e in ("sql", "python")]
        for r in df.select("t", *engines).collect():
            for i in range(2):
                s, p = r[f"sql{i}"], r[f"python{i}"]
                assert s == p, (grammar.regex().pattern, r)  # value, rest and error with its place and message
    assert compared > 12


def test_errors_are_located_alike_in_both_engines(spark):
    big = "9" * 25
    even = g.digits().flatten(lambda n: n if n % 2 == 0 else None, "decimal(20,0)", lambda c: F.when(c % 2 == 0, c), "an odd number")
    line = g.record().keep("n", even).skip(g.lit(";")).keep("w", g.alt(g.lit("up"), g.record().skip(g.lit("do")).keep("x", g.lit("wn")).map(lambda v: v["x"], "string", lambda c: c["x"]))).skip(g.lit("\n"))
    grammars = [
        (g.fail("boom"), ["x", ""]), (g.record().skip(g.lit("a")).skip(g.fail("stop")), ["ab", "b"]), (even, ["3", "4", "x", big]),
        (g.record().keep("a", line).keep("b", line), ["2;up\n4;up\n", "2;up\n5;up\n", "2;up\n4;dorn\n", "2;up\n4;x", "1;up", "2:up", f"2;up\n{big};up", "", "2;up\n4;up\nmore"]),
        (g.record().skip(g.take_until(":")).skip(g.lit(":")).keep("n", g.digits()), ["é\n:x", "none", ":1", f"a:{big}"]),
        (g.digits().sep_by1(g.lit(",")), ["1,2", "x", "", f"1,{big}", "1,2,"]), (g.one("a-c").one_or_more(), ["d", "abz"]), (g.digits().sep_by(g.lit(" ")), [big, "1 2x"]),
        (g.one_of([g.lit("one"), g.lit("two"), g.lit("three")]), ["four", "two"]), (g.digits().maybe(), [big, "x"]),
    ]
    for grammar, texts in grammars:
        assert grammar.regular
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        engines = [parse("t", grammar, engine=e).alias(f"{e}{i}") for i, parse in enumerate((parse_column, parse_prefix)) for e in ("sql", "python")]
        for r in df.select("t", *engines).collect():
            for i in range(2):
                assert r[f"sql{i}"] == r[f"python{i}"], r
    assert one(spark, "x", g.fail("boom"))["error"].asDict() == {"kind": "ParsingFailure", "message": "boom", "line": 1, "col": 1, "record": None}


def test_bytes_that_are_no_text(spark):
    df = spark.createDataFrame([(bytearray("é!".encode()),), (bytearray(b"\xff\xfe"),)], "b binary")
    rows = [r["r"] for r in df.select(parse_bytes("b", g.utf8_text()).alias("r")).collect()]
    assert [r["val"] for r in rows] == ["é!", None] and rows[1]["error"]["message"] == "the bytes are no UTF-8"


def test_a_lazy_grammar_is_built_once_and_not_for_every_level_of_every_text():
    built = []

    def nested():
        built.append(1)
        return g.alt(g.lit("x").map(lambda v: 0, "int"), g.lit("(").skip_then(g.lazy(nested, "int")).then_skip(g.lit(")")).map(lambda n: n + 1, "int"))

    grammar = g.lazy(nested, "int")
    for depth in [3, 0, 40, 7] * 5:
        text = "(" * depth + "x" + ")" * depth
        assert run(grammar, text, True)["val"] == depth
        assert not run(grammar, "(" + text, True)["ok"] and run(grammar, text + ")", True)["error"]["col"] == 2 * depth + 2
    assert len(built) == 1


def test_lazy_makers_that_are_new_each_time_stay_apart_and_are_not_kept_without_bound():
    # a maker's own depth decides what it makes, so one taken for another would show
    def down(depth):
        return g.lazy(lambda: g.lit(f"{depth};").skip_then(down(depth - 1)) if depth else g.lit("end"), "string")

    for n in range(2 * g._MADE_MOST // 10):
        text = "".join(f"{d};" for d in range(9, 0, -1)) + "end"
        assert run(down(9), text, True)["val"] == "end" and not run(down(8), text, True)["ok"]
        assert len(g._MADE) <= g._MADE_MOST


def test_a_text_that_repeats_in_a_batch_is_parsed_once(spark):
    calls = []

    def count(text, at):
        calls.append(text)
        return (len(calls), len(text)) if text.startswith("a") else "no a"

    texts = ["a1", "b", "a2", None, "a1", "b", None, "a2", "", "a1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    rows = [r["r"] for r in df.select(parse_column("t", g.primitive(count, "int")).alias("r")).collect()]
    assert [r and r["val"] for r in rows] == [1, None, 3, None, 1, None, None, 3, None, 1]
    assert [r is None for r in rows] == [t is None for t in texts]
    assert [r["error"]["message"] for r, t in zip(rows, texts) if t in ("b", "")] == ["no a"] * 3

    # values, rests and errors of each row are its own
    words = g.lazy(lambda: g.chars("a-c").sep_by1(g.lit(",")), "array<string>")
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc,;\n") for _ in range(rng.randrange(4))) if rng.random() < 0.9 else None for _ in range(500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    for parse, whole in ((parse_column, True), (parse_prefix, False)):
        for r in df.select("i", parse("t", words).alias("r")).collect():
            t = texts[r["i"]]
            assert (r["r"] and r["r"].asDict(True)) == (None if t is None else run(words, t, whole))
