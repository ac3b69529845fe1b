"""Driver queries for the rest of the grammar algebra, the formats and the relational plans around them."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import csv as C
from loomtext.functions import http, markdown, xml, yaml
from loomtext.functions.registry import register
from loomtext.functions.text import text_from_ascii, text_from_utf8
from loomtext.operators import grammar as g
from loomtext.operators import parse_bytes, parse_column, parse_prefix
from loomtext.plans.parser_queries import PROPS, URL, _request_text, query, table
from loomtext.streaming.parse import parse_stream

BIG = "bigint"


def text_of(column: str) -> F.Column:
    return F.col(column).cast("string")


# grammars
NAMED = g.one_of([g.lit("BUILDING"), g.lit("AUTOMOBILE"), g.fail("no such segment")])
EVEN = g.record().skip(g.lit("Brand#")).keep("n", g.digits().flatten(lambda n: n if n % 2 == 0 else None, "int", lambda c: F.when(c % 2 == 0, c.cast("int")), "an odd number"))
YEAR_MONTH = g.map2(g.digits().then_skip(g.lit("-")), g.digits(), lambda y, m: y * 12 + m, BIG, lambda y, m: y * 12 + m)
YEAR_MONTH_DAY = g.map3(
    g.digits().then_skip(g.lit("-")), g.digits().then_skip(g.lit("-")), g.digits(), lambda y, m, d: y * 10000 + m * 100 + d, BIG, lambda y, m, d: y * 10000 + m * 100 + d
)
SIGNED = g.apply(g.alt(g.lit("-").map(lambda v: (lambda n: -n), "string"), g.const("").map(lambda v: (lambda n: n), "string")), g.digits(), BIG)


def _nested():
    deeper = g.lit("(").skip_then(g.lazy(_nested, "int")).then_skip(g.lit(")")).map(lambda n: n + 1, "int")
    return g.alt(g.lit("x").map(lambda v: 0, "int"), deeper)


COUNTED = g.digits().then_skip(g.lit(":")).and_then(lambda n: g.chars(r"\s\S", least=int(n), most=int(n)), "string")
COLOR = g.one_of([g.lit("red"), g.lit("green"), g.lit("blue")])
SHOWN = g.record().keep("count", g.digits()).skip(g.lit(" ")).keep("color", COLOR)
ROUNDS = g.record().skip(g.lit("Game ")).keep("id", g.digits()).skip(g.lit(": ")).keep("sets", SHOWN.sep_by1(g.lit(", ")).sep_by1(g.lit("; ")))
TRUTH = g.one_of([g.lit("true").map(lambda v: True, "boolean", lambda c: F.lit(True)), g.lit("false").map(lambda v: False, "boolean", lambda c: F.lit(False))])
AFTER_TEXT = g.take_while("^0-9").skip_then(g.digits())
AFTER_NUMBER = g.take_while("0-9").skip_then(g.rest())


@query(
    """SELECT c_custkey, s IN ('BUILDING', 'AUTOMOBILE') AS ok, CASE WHEN s NOT IN ('BUILDING', 'AUTOMOBILE') THEN 'expected ''BUILDING'' or expected ''AUTOMOBILE'' or no such segment' END AS message,
    CASE WHEN s NOT IN ('BUILDING', 'AUTOMOBILE') THEN 1 END AS line FROM (SELECT c_custkey, c_mktsegment AS s FROM customer)"""
)
def fail_message(spark, sf_dir):
    r = parse_column("c_mktsegment", NAMED)
    return table(spark, sf_dir, "customer").select("c_custkey", r["ok"].alias("ok"), r["error"]["message"].alias("message"), r["error"]["line"].cast("int").alias("line"))


@query(
    """SELECT p_partkey, CASE WHEN n % 2 = 0 THEN n END AS n, CASE WHEN n % 2 = 1 THEN 'an odd number' END AS message, CASE WHEN n % 2 = 1 THEN 7 END AS col
    FROM (SELECT p_partkey, CAST(substr(p_brand, 7) AS INTEGER) AS n FROM part)"""
)
def flatten_even(spark, sf_dir):
    r = parse_column("p_brand", EVEN)
    return table(spark, sf_dir, "part").select("p_partkey", r["val"]["n"].alias("n"), r["error"]["message"].alias("message"), r["error"]["col"].cast("int").alias("col"))


@query(
    """SELECT o_orderkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS months,
    CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS BIGINT) AS ymd FROM orders"""
)
def map2_map3_dates(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", parse_prefix(day, YEAR_MONTH)["val"].alias("months"), parse_column(day, YEAR_MONTH_DAY)["val"].alias("ymd"))


@query("SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer")
def apply_sign(spark, sf_dir):
    cents = F.round(F.col("c_acctbal") * 100).cast(BIG).cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", parse_column(cents, SIGNED)["val"].alias("cents"))


@query("SELECT p_partkey, p_size % 7 AS depth, p_size % 5 <> 0 AS closed FROM part")
def lazy_nesting(spark, sf_dir):
    opened = (F.col("p_size") % 7).cast("int")
    text = F.concat(F.repeat(F.lit("("), opened), F.lit("x"), F.repeat(F.lit(")"), opened))
    # without its last character where the size divides by five: a parse error, unless nothing was left to lack
    short = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("("), text)).otherwise(text)
    rows = table(spark, sf_dir, "part").select("p_partkey", parse_column(text, g.lazy(_nested, "int"))["val"].alias("depth"), parse_column(short, g.lazy(_nested, "int"))["ok"].alias("closed"))
    return rows


@query(
    """SELECT p_partkey, CAST(p_size % 5 AS INTEGER) AS n, CAST((p_size % 5) * (p_size % 5 + 1) // 2 AS BIGINT) AS total, length(regexp_extract(p_type, '^[A-Z]+')) AS letters,
    true AS ignored, CAST(substr(p_brand, 7) AS BIGINT) AS brand, p_name AS counted, p_type AS after_counted FROM part"""
)
def repeats_and_and_then(spark, sf_dir):
    n = (F.col("p_size") % 5).cast("int")
    numbers = F.when(n > 0, F.array_join(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), ",")).otherwise("")
    listed = parse_column(numbers, g.digits().sep_by(g.lit(",")))["val"]
    brand = parse_column("p_brand", g.record().keep("gone", g.lit("Brand#").ignore()).keep("n", g.digits()))["val"]
    counted = parse_prefix(F.concat(F.length("p_name").cast("string"), F.lit(":"), F.col("p_name"), F.col("p_type")), COUNTED)
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.size(listed).alias("n"), F.aggregate(listed, F.lit(0).cast(BIG), lambda a, b: a + b.cast(BIG)).alias("total"),
        F.size(parse_prefix("p_type", g.one("A-Z").one_or_more())["val"]).cast(BIG).alias("letters"),
        brand["gone"].isNull().alias("ignored"), brand["n"].cast(BIG).alias("brand"), counted["val"].alias("counted"), counted["rest"].alias("after_counted"),
    )


@query("SELECT item_id, text, CAST(strlen(text) AS BIGINT) AS bytes, false AS broken FROM benchmark WHERE text IS NOT NULL AND text <> ''")
def bytes_and_text(spark, sf_dir):
    data = F.encode("text", "UTF-8")
    whole, every = parse_bytes(data, g.utf8_text()), parse_bytes(data, g.rest())
    broken = parse_bytes(F.concat(data, F.unhex(F.lit("FF"))), g.utf8_text())
    rows = table(spark, sf_dir, "benchmark").where("text is not null and text <> ''")
    return rows.select("item_id", whole["val"].alias("text"), F.length(every["val"]).cast(BIG).alias("bytes"), broken["ok"].alias("broken"))


@query(
    """SELECT p_partkey, ascii(substr(p_name, 1, 1)) AS code, substr(p_name, 2) AS others, substr(p_name, 1, 1) BETWEEN 'a' AND 'm' AS early, p_brand AS brand,
    chr(65 + p_size % 26) AS letter FROM part"""
)
def code_units(spark, sf_dir):
    name = F.encode("p_name", "UTF-8")
    first = parse_bytes(name, g.any_char(), whole=False)
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.ascii(first["val"]).alias("code"), first["rest"].alias("others"), parse_bytes(name, g.one("a-m"), whole=False)["ok"].alias("early"),
        text_from_utf8(F.encode("p_brand", "UTF-8")).alias("brand"), text_from_ascii(F.lit(65) + F.col("p_size") % 26).alias("letter"),
    )


@query(
    """SELECT p_partkey, p_size AS reds, 2 AS rounds, CAST(p_size + 1 AS BIGINT) AS most, p_partkey % 2 = 0 AS even, CAST(substr(p_brand, 7) AS BIGINT) AS number, ' of ' || p_name AS words,
    p_size % 3 = 0 AS at_sign FROM part"""
)
def sample_grammars(spark, sf_dir):
    text = F.concat(F.lit("Game "), text_of("p_partkey"), F.lit(": "), text_of("p_size"), F.lit(" red, 1 blue; "), (F.col("p_size") + 1).cast("string"), F.lit(" green"))
    v = parse_column(text, ROUNDS)["val"]
    shown = F.flatten(v["sets"])
    even = F.when(F.col("p_partkey") % 2 == 0, F.lit("true")).otherwise("false")
    mark = F.when(F.col("p_size") % 3 == 0, F.lit("@")).otherwise("a")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.get(F.filter(shown, lambda x: x["color"] == "red"), F.lit(0))["count"].cast("int").alias("reds"), F.size(v["sets"]).alias("rounds"),
        F.array_max(F.transform(shown, lambda x: x["count"].cast(BIG))).alias("most"), parse_column(even, TRUTH)["val"].alias("even"),
        parse_column("p_brand", AFTER_TEXT)["val"].cast(BIG).alias("number"), parse_column(F.concat(text_of("p_size"), F.lit(" of "), F.col("p_name")), AFTER_NUMBER)["val"].alias("words"),
        parse_column(mark, g.one("@"))["ok"].alias("at_sign"),
    )


@query("SELECT CAST(max(total) AS BIGINT) AS best FROM (SELECT o_orderkey // 10 AS part, sum(o_orderkey) AS total FROM orders GROUP BY 1)")
def numbers_best(spark, sf_dir):
    # ten numbers a group, each ended by a line end, then a blank line
    rows = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 10).alias("part")).agg(F.concat(F.array_join(F.collect_list(text_of("o_orderkey")), "\n"), F.lit("\n\n")).alias("text"))
    lines = g.digits().then_skip(g.lit("\n")).many().then_skip(g.lit("\n"))
    total = F.aggregate(parse_column("text", lines)["val"], F.lit(0).cast(BIG), lambda a, b: a + b.cast(BIG))
    return rows.agg(F.max(total).alias("best"))


# formats
@query("SELECT c_custkey, c_acctbal AS balance, 3 AS fields, 'a \"b\", c' AS quoted FROM customer")
def csv_record_fields(spark, sf_dir):
    line = F.concat(text_of("c_custkey"), F.lit(","), text_of("c_acctbal"), F.lit(',"a ""b"", c"'))
    fields = C.csv_record(line)["fields"]
    v = C.decode_record(fields, (C.u64("key"), C.f64("balance"), C.string("quoted")))["val"]
    return table(spark, sf_dir, "customer").select(v["key"].cast(BIG).alias("c_custkey"), v["balance"].alias("balance"), F.size(fields).alias("fields"), v["quoted"].alias("quoted"))


@query(
    """SELECT p_partkey // 10 AS file, count(*) AS movies, string_agg('The movie ''' || p_name || ''' was released in ' || (1900 + p_size) || ' and stars ' ||
    CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || ' and ' || p_type ELSE p_brand || ', ' || p_type || ' and Ann' END, chr(10) ORDER BY p_partkey) AS said FROM part GROUP BY 1"""
)
def csv_movies(spark, sf_dir):
    stars = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).when(F.col("p_partkey") % 3 == 1, F.concat_ws(",", "p_brand", "p_type")).otherwise(F.concat_ws(",", "p_brand", "p_type", F.lit("Ann")))
    line = F.concat(F.col("p_name"), F.lit(","), (F.col("p_size") + 1900).cast("string"), F.lit(',"'), stars, F.lit('"'))
    files = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") / 10).cast(BIG).alias("file")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))).alias("r"))
    movies = C.decode_text(F.array_join(F.col("r.line"), "\n"), (C.string("title"), C.u64("year"), C.string("stars")))["val"]

    def sentence(m):
        names = F.split(m["stars"], ",")
        others = F.array_join(F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0))), ", ")
        listed = F.when(F.size(names) > 1, F.concat(others, F.lit(" and "), F.element_at(names, -1))).otherwise(F.element_at(names, 1))
        return F.concat(F.lit("The movie '"), m["title"], F.lit("' was released in "), m["year"].cast("string"), F.lit(" and stars "), listed)

    return files.select("file", F.size(movies).cast(BIG).alias("movies"), F.array_join(F.transform(movies, sentence), "\n").alias("said"))


@query(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'number out of range' END AS message, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_suppkey % 65536 AS INTEGER) END AS status_code FROM supplier"""
)
def http_number_range(spark, sf_dir):
    code = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("18446744073709551616"), text_of("s_suppkey"))).otherwise(text_of("s_suppkey"))
    r = http.http_response(F.concat(F.lit("HTTP/1.1 "), code, F.lit(" OK\r\nA: b\r\n\r\n")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", r["error"]["message"].alias("message"), r["val"]["status_code"].alias("status_code"))


@query(
    """SELECT s_suppkey, 'svg [' || chr(10) || '    width "' || s_nationkey || '",' || chr(10) || '    class "a b"' || chr(10) || '] [' || chr(10) || '    path [' || chr(10) || '        d "' || s_name || '"' || chr(10)
    || '    ] [],' || chr(10) || '    g [] [' || chr(10) || '        text "' || s_suppkey || '"' || chr(10) || '    ]' || chr(10) || ']' AS dsl FROM supplier"""
)
def xml_svg(spark, sf_dir):
    text = F.concat(F.lit('<svg width="'), text_of("s_nationkey"), F.lit('" class="a b"><path d="'), F.col("s_name"), F.lit('"/><g>'), text_of("s_suppkey"), F.lit("</g></svg>"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", xml.xml_dsl(text).alias("dsl"))


@query(
    """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'ok' ELSE 'error' END AS said, CASE WHEN s_suppkey % 4 = 0 THEN s_name || ' é' END AS text FROM supplier"""
)
def xml_cases(spark, sf_dir):
    kind, name = F.col("s_suppkey") % 4, F.col("s_name")
    good = F.concat(F.lit("<a>"), name, F.lit(" é</a>\n"))
    bad = F.when(kind == 1, F.concat(F.lit("<a>"), name, F.lit("<b/>"))).when(kind == 2, F.concat(F.lit("<a"), name, F.lit("</a>"))).otherwise(F.concat(F.lit("<a>"), name, F.lit("</a>more")))
    p = xml.xml_parse(F.when(kind == 0, good).otherwise(bad))
    said = F.when(p["error"].isNull(), "ok").otherwise("error")
    return table(spark, sf_dir, "supplier").select("s_suppkey", said.alias("said"), F.get(F.filter(p["nodes"], lambda n: n["kind"] == "text"), F.lit(0))["text"].alias("text"))


@query(
    """SELECT s_suppkey, 'Mapping([{ key: "name", value: String("' || s_name || '") }, { key: "tab", value: String("a' || chr(92) || 't' || s_suppkey || '") }, { key: "quote", value: String("it''s ' || s_nationkey
    || '") }, { key: "flow", value: Sequence([Int(' || s_suppkey || '), Bool(True), Null, Mapping([{ key: "k", value: Int(' || s_nationkey || ') }])]) }])' AS shown FROM supplier"""
)
def yaml_debug_text(spark, sf_dir):
    n, k = text_of("s_suppkey"), text_of("s_nationkey")
    text = F.concat(
        F.lit("name: '"), F.col("s_name"), F.lit("'\ntab: \"a\\t"), n, F.lit("\"\nquote: 'it''s "), k, F.lit("'\nflow: ["), n, F.lit(", true, null, {k: "), k, F.lit("}]\n")
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey", yaml.yaml_debug(text).alias("shown"))


@query(
    """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'int' WHEN 1 THEN 'float' WHEN 2 THEN 'string' WHEN 3 THEN 'bool' ELSE 'null' END AS kind, CASE WHEN p_size % 5 = 0 THEN CAST(-p_partkey AS BIGINT) END AS int_v,
    CASE WHEN p_size % 5 = 1 THEN CAST(p_retailprice AS DOUBLE) END AS float_v, CASE WHEN p_size % 5 = 2 THEN p_name END AS str_v, CASE WHEN p_size % 5 = 3 THEN p_partkey % 2 = 0 END AS bool_v FROM part"""
)
def yaml_kinds(spark, sf_dir):
    kind = F.col("p_size") % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("-"), text_of("p_partkey"))).when(kind == 1, F.format_string("%.2f", F.col("p_retailprice").cast("double")))
        .when(kind == 2, F.col("p_name")).when(kind == 3, (F.col("p_partkey") % 2 == 0).cast("string")).otherwise("~")
    )
    n = F.get(F.col("n"), F.lit(0))
    rows = table(spark, sf_dir, "part").select("p_partkey", yaml.yaml_parse(text)["nodes"].alias("n"))
    return rows.select("p_partkey", n["kind"].alias("kind"), n["int_v"].alias("int_v"), n["float_v"].alias("float_v"), n["str_v"].alias("str_v"), n["bool_v"].alias("bool_v"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size % 5 + 2 END AS line, CASE WHEN p_partkey % 3 <> 0 THEN p_size % 5 + 3 END AS nodes FROM part")
def yaml_error_places(spark, sf_dir):
    # keys k0, k1, ..., then one more: every third time a repeated one
    n = (F.col("p_size") % 5).cast("int")
    keys = F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(F.lit("k"), i.cast("string"), F.lit(": "), i.cast("string"), F.lit("\n")))
    last = F.when(F.col("p_partkey") % 3 == 0, F.lit("k0: again")).otherwise("other: 1")
    rows = table(spark, sf_dir, "part").select("p_partkey", yaml.yaml_parse(F.concat(F.array_join(keys, ""), last)).alias("y"))
    y = F.col("y")
    return rows.select("p_partkey", y["error"]["line"].cast("int").alias("line"), F.when(y["error"].isNull(), F.size(y["nodes"])).alias("nodes"))


@query(
    """SELECT p_partkey, 'Blockquote([Paragraph([Text("' || p_name || ' "), Strong([Text("' || p_brand || '")])])])' AS quote, 'HtmlBlock("<div>' || p_size || '</div>' || chr(92) || 'n")' AS html,
    'ThematicBreak' AS rule, 'pic ' || p_size AS label, '/' || p_partkey AS href, CASE WHEN p_size % 2 = 0 THEN 'ti tle' END AS title,
    'BLOCKQUOTE:' || chr(10) || 'PARAGRAPH: ' || p_name || ' **' || p_brand || '**' || chr(10) AS outline FROM part"""
)
def md_other_blocks(spark, sf_dir):
    quote = F.concat(F.lit("> "), F.col("p_name"), F.lit(" **"), F.col("p_brand"), F.lit("**"))
    text = F.concat(quote, F.lit("\n\n<div>"), text_of("p_size"), F.lit("</div>\n\n---\n"))
    parts = F.split(F.regexp_replace(markdown.md_debug(text), r"\A\[|\]\z", ""), r", (?=HtmlBlock|ThematicBreak)")
    title = F.when(F.col("p_size") % 2 == 0, F.lit(" 'ti tle'")).otherwise("")
    image = markdown.md_image(F.concat(F.lit("![pic "), text_of("p_size"), F.lit("](/"), text_of("p_partkey"), title, F.lit(")")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.get(parts, F.lit(0)).alias("quote"), F.get(parts, F.lit(1)).alias("html"), F.get(parts, F.lit(2)).alias("rule"),
        image["label"].alias("label"), image["href"].alias("href"), image["title"].alias("title"), markdown.md_render(quote).alias("outline"),
    )


@query(
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 4 END AS blocks, CASE page_id % 4 WHEN 0 THEN 'heading,paragraph' WHEN 1 THEN 'paragraph,thematic_break,code'
    WHEN 2 THEN 'html' ELSE 'blockquote,heading,paragraph,paragraph' END AS kinds, url AS href FROM pages"""
)
def md_mixed_documents(spark, sf_dir):
    url, kind = F.col("url"), F.col("page_id") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("# T\nsee <"), url, F.lit(">"))).when(kind == 1, F.concat(F.lit("see "), url, F.lit("\n\n***\n```\nx\n```")))
        .when(kind == 2, F.concat(F.lit("<div>"), url, F.lit("</div>"))).otherwise(F.concat(F.lit("> [a]("), url, F.lit(")\n\nTwo\n---\nb\n\nc")))
    )
    p = F.col("p")
    top = F.filter(p["blocks"], lambda b: b["depth"] == 0)
    href = F.get(F.filter(p["inlines"], lambda n: n["kind"] == "link"), F.lit(0))["href"]
    raw = F.regexp_extract(F.get(top, F.lit(0))["raw"], "<div>(.*)</div>", 1)
    rows = table(spark, sf_dir, "pages").select("page_id", markdown.md_parse(text).alias("p"))
    return rows.select("page_id", F.size(top).alias("blocks"), F.array_join(F.transform(top, lambda b: b["kind"]), ",").alias("kinds"), F.coalesce(href, raw).alias("href"))


@query("SELECT p_partkey, CAST(n AS BIGINT) AS record_no, CASE n WHEN 1 THEN p_name ELSE p_type END AS first, CASE n WHEN 1 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS second FROM part, (VALUES (1), (2)) AS v(n)")
def sql_table_function(spark, sf_dir):
    register(spark)
    text = F.concat(F.col("p_name"), F.lit(',"'), F.col("p_brand"), F.lit('"\n'), F.col("p_type"), F.lit(","), text_of("p_size"))
    table(spark, sf_dir, "part").select("p_partkey", text.alias("text")).createOrReplaceTempView("loomtext_part_csv")
    return spark.sql("SELECT p.p_partkey, r.record_no, r.fields[0] AS first, r.fields[1] AS second FROM loomtext_part_csv p, LATERAL csv_rows(p.text) r")


# plans around parsed columns
def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", parse_column("props", PROPS)["val"]["k"].cast(BIG).alias("k"))


_EVENTS_SQL = "(SELECT event_id, ts, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"


@query(f"SELECT event_type, CAST(k % 3 AS BIGINT) AS third, count(DISTINCT k) AS kinds, CAST(sum(k) AS BIGINT) AS total FROM {_EVENTS_SQL} GROUP BY CUBE (event_type, k % 3)")
def cube_parsed(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("third", F.col("k") % 3)
    return rows.cube("event_type", "third").agg(F.count_distinct("k").alias("kinds"), F.sum("k").alias("total"))


@query(f"SELECT event_id, k FROM {_EVENTS_SQL} ORDER BY k DESC, event_id LIMIT 20")
def top_parsed(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", "k").orderBy(F.desc("k"), "event_id").limit(20)


@query(
    f"""SELECT k, 'both' AS held FROM (SELECT k FROM {_EVENTS_SQL} WHERE event_type = 'error' INTERSECT SELECT k FROM {_EVENTS_SQL} WHERE event_type = 'click')
    UNION ALL SELECT k, 'error only' FROM (SELECT k FROM {_EVENTS_SQL} WHERE event_type = 'error' AND user_id % 50 = 0 EXCEPT SELECT k FROM {_EVENTS_SQL} WHERE event_type = 'click' AND user_id % 50 = 1)"""
)
def set_operations_parsed(spark, sf_dir):
    e = _events(spark, sf_dir)
    of = lambda kind, rest: e.where((F.col("event_type") == kind) & ((F.col("user_id") % 50 == rest) if rest is not None else F.lit(True))).select("k")
    both = of("error", None).intersect(of("click", None)).withColumn("held", F.lit("both"))
    return both.union(of("error", 0).subtract(of("click", 1)).withColumn("held", F.lit("error only")))


@query("SELECT page_id, url FROM pages WHERE regexp_extract(url, '^https?://([^/?#]+)', 1) IN (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) FROM pages WHERE page_id % 10 = 3)")
def semi_join_parsed(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select("page_id", "url", parse_column("url", URL)["val"]["host"].alias("host"))
    return hosts.join(hosts.where("page_id % 10 = 3").select("host"), "host", "left_semi").select("page_id", "url")


@query(
    """SELECT c.c_custkey, p.p_partkey FROM (SELECT c_custkey, CAST(substr(c_name, 10) AS BIGINT) AS n FROM customer) c JOIN part p
    ON c.n >= p.p_partkey * 7 AND c.n < p.p_partkey * 7 + 1 + p.p_size % 4"""
)
def interval_join_parsed(spark, sf_dir):
    number = parse_column("c_name", g.take_until("#").skip_then(g.lit("#")).skip_then(g.digits()))["val"].cast(BIG)
    points = table(spark, sf_dir, "customer").select("c_custkey", number.alias("n")).withColumn("cell", F.floor(F.col("n") / 8))
    low = F.col("p_partkey") * 7
    spans = table(spark, sf_dir, "part").select("p_partkey", low.alias("low"), (low + 1 + F.col("p_size") % 4).alias("high"))
    # equal cells instead of a product: an interval is in all the cells that it touches
    celled = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / 8), F.floor((F.col("high") - 1) / 8))))
    return points.join(celled, "cell").where("n >= low and n < high").select("c_custkey", "p_partkey")


@query(
    f"""SELECT e.event_id, (SELECT max(b.event_id) FROM {_EVENTS_SQL} b WHERE b.user_id = e.user_id AND b.event_type = 'click' AND b.ts <= e.ts AND b.event_id <= e.event_id) AS click FROM {_EVENTS_SQL} e WHERE e.k % 10 = 0"""
)
def as_of_parsed(spark, sf_dir):
    # the latest click of the same user: one sorted pass over each user's events, no pairs
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = _events(spark, sf_dir).withColumn("click", F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).over(before))
    return rows.where("k % 10 = 0").select("event_id", "click")


@query(
    f"""SELECT event_id, k, k * k AS square, date_trunc('day', ts) AS day, CAST(k AS DOUBLE) AS as_double FROM {_EVENTS_SQL}"""
)
def functions_parsed(spark, sf_dir):
    pairs = F.map_from_arrays(F.array(F.lit("k")), F.array(F.col("k")))
    json = F.from_json(F.to_json(F.struct("k")), "k bigint")["k"]
    return _events(spark, sf_dir).select(
        "event_id", F.element_at(pairs, "k").alias("k"), F.pow("k", F.lit(2)).cast(BIG).alias("square"), F.date_trunc("day", "ts").alias("day"), json.cast("double").alias("as_double")
    )


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def stream_totals(spark, sf_dir):
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    good, _ = parse_stream(rows, parse_column("props", PROPS), keep=("event_type",))
    totals = good.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("val.k").cast(BIG)).alias("total"))
    writer = totals.writeStream.outputMode("complete").format("memory").queryName("loomtext_totals").trigger(availableNow=True)
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        writer = writer.option("checkpointLocation", f"{folder}/streams/{uuid4()}")
    writer.start().awaitTermination()
    return spark.table("loomtext_totals")


@query(
    """SELECT page_id, 2 AS major, 'x' || page_id AS body FROM pages WHERE page_id % 2 = 0
    UNION ALL SELECT page_id, 1, 'body ' || page_id FROM pages WHERE page_id % 2 = 1"""
)
def union_parsed(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    v = http.http_request(_request_text())["val"]
    odd = pages.where("page_id % 2 = 1").select("page_id", v["version"]["major"].cast("int").alias("major"), F.decode(v["body"], "UTF-8").alias("body"))
    text = F.concat(F.lit("HTTP/2.0 200 OK\r\nA: b\r\n\r\nx"), text_of("page_id"))
    w = http.http_response(F.encode(text, "UTF-8"), binary=True)["val"]
    even = pages.where("page_id % 2 = 0").select("page_id", w["version"]["major"].cast("int").alias("major"), F.decode(w["body"], "UTF-8").alias("body"))
    return even.union(odd)
