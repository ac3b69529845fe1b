"""Driver queries over the parsers, each with the SQL that gives the same rows.

Where the tables hold no text of a format, rows are rendered into it first and parsed
back; the SQL then states the original columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions import csv as C
from loomtext.functions import http, markdown, xml, yaml
from loomtext.operators import grammar as g
from loomtext.operators import parse_column, parse_prefix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# grammars
PROPS = g.record().skip(g.lit('{"k": ')).keep("k", g.digits()).skip(g.lit("}"))
CUSTOMER = g.record().skip(g.take_until("#")).skip(g.lit("#")).keep("number", g.digits())
PRIORITY = g.record().keep("rank", g.digit()).skip(g.lit("-")).keep(
    "word", g.one_of([g.lit("URGENT"), g.lit("HIGH"), g.lit("MEDIUM"), g.lit("NOT SPECIFIED").map(lambda v: "NONE", "string", lambda c: F.lit("NONE")), g.lit("LOW")])
)
WORDS = g.chars("^ ").sep_by1(g.lit(" "))
URL = (
    g.record()
    .keep("scheme", g.alt(g.lit("https"), g.lit("http")))
    .skip(g.lit("://"))
    .keep("host", g.chars("^/?#"))
    .keep("path", g.take_while("^?#"))
    .keep("query", g.lit("?").skip_then(g.chars("^#")).maybe())
    .keep("fragment", g.lit("#").skip_then(g.chars(r"\s\S")).maybe())
)
BRAND = g.digits().map(lambda v: v if v < 1 << 31 else None, "int", lambda c: c.cast("int")).between(g.lit("Brand#"), g.const(""))
SEGMENT = g.one_of([g.lit("AUTOMOBILE"), g.lit("MACHIN"), g.lit("BUILDING"), g.lit("HOUSE")])


def _next_a(text: str, at: int):
    found = text.find("A", at)
    return (1, found + 1) if found >= 0 else "no more letters"


LETTERS = g.primitive(_next_a, "bigint").many()
NUMBER_GROUPS = g.digits().sep_by1(g.lit("\n")).sep_by1(g.lit("\n\n"))


@query(
    """SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total
    FROM events GROUP BY event_type"""
)
def props_by_type(spark, sf_dir):
    k = parse_column("props", PROPS)["val"]["k"].cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))


@query("SELECT c_custkey, CAST(substr(c_name, 10) AS BIGINT) AS number FROM customer")
def digits_extract(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", parse_column("c_name", CUSTOMER)["val"]["number"].cast("bigint").alias("number"))


@query(
    """SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS rank,
    replace(substr(o_orderpriority, 3), 'NOT SPECIFIED', 'NONE') AS word FROM orders"""
)
def one_of_priority(spark, sf_dir):
    val = parse_column("o_orderpriority", PRIORITY)["val"]
    return table(spark, sf_dir, "orders").select("o_orderkey", val["rank"].cast("bigint").alias("rank"), val["word"].alias("word"))


@query(
    """SELECT p_partkey, CAST(i AS INTEGER) AS ord, w[i + 1] AS word
    FROM (SELECT p_partkey, w, unnest(range(len(w))) AS i FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part))"""
)
def sep_by_split(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(parse_column("p_name", WORDS)["val"]).alias("ord", "word"))


@query(
    r"""SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
    regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '\?([^#]+)', 1), '') AS query,
    nullif(regexp_extract(url, '#(.+)$', 1), '') AS fragment FROM pages"""
)
def maybe_fragment(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", parse_column("url", URL)["val"].alias("v")).select("page_id", "v.*")


@query("SELECT p_partkey, CAST(substr(p_brand, 7) AS INTEGER) AS brand FROM part")
def between_brand(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", parse_column("p_brand", BRAND)["val"].alias("brand"))


@query(
    """SELECT c_custkey, s IN ('AUTOMOBILE', 'BUILDING') AS ok,
    CASE s WHEN 'MACHINERY' THEN 'ERY' WHEN 'HOUSEHOLD' THEN 'HOLD' WHEN 'FURNITURE' THEN NULL ELSE '' END AS left_over,
    CASE s WHEN 'MACHINERY' THEN 'ParsingIncomplete' WHEN 'HOUSEHOLD' THEN 'ParsingIncomplete' WHEN 'FURNITURE' THEN 'ParsingFailure' END AS error_kind
    FROM (SELECT c_custkey, c_mktsegment AS s FROM customer)"""
)
def parse_incomplete(spark, sf_dir):
    r = parse_column("c_mktsegment", SEGMENT)
    return table(spark, sf_dir, "customer").select("c_custkey", r["ok"].alias("ok"), r["rest"].alias("left_over"), r["error"]["kind"].alias("error_kind"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment LIKE 'MACHIN%' THEN 'ERY' END AS after_prefix FROM customer")
def parse_prefix_rest(spark, sf_dir):
    r = parse_prefix("c_mktsegment", g.lit("MACHIN"))
    return table(spark, sf_dir, "customer").select("c_custkey", r["rest"].alias("after_prefix"))


@query("SELECT doc_id, CAST(length(text) - length(replace(text, 'A', '')) AS BIGINT) AS letters FROM documents")
def many_letters(spark, sf_dir):
    counted = F.aggregate(parse_prefix("text", LETTERS)["val"], F.lit(0).cast("bigint"), lambda total, x: total + x)
    return table(spark, sf_dir, "documents").select("doc_id", counted.alias("letters"))


@query(
    """SELECT o_custkey, max(total) AS best FROM (SELECT o_custkey, o_orderpriority, CAST(sum(o_orderkey) AS BIGINT) AS total
    FROM orders GROUP BY o_custkey, o_orderpriority) GROUP BY o_custkey"""
)
def group_max(spark, sf_dir):
    # a customer's orders as lines of numbers, one group a priority led by its digit, groups parted by a blank line;
    # a text has the orders of 1,000 consecutive keys, however many a customer has
    keyed = table(spark, sf_dir, "orders").withColumn("part", F.floor(F.col("o_orderkey") / 1000))
    joined = lambda c, by: F.array_join(F.collect_list(c), by)
    lines = keyed.groupBy("o_custkey", "part", "o_orderpriority").agg(joined(F.col("o_orderkey").cast("string"), "\n").alias("keys"))
    group = F.concat(F.substring("o_orderpriority", 1, 1), F.lit("\n"), F.col("keys"))
    texts = lines.groupBy("o_custkey", "part").agg(joined(group, "\n\n").alias("text"))
    groups = texts.select("o_custkey", F.explode(parse_column("text", NUMBER_GROUPS)["val"]).alias("g"))
    total = F.aggregate("g", F.lit(0).cast("bigint"), lambda a, b: a + b.cast("bigint")) - F.get("g", F.lit(0)).cast("bigint")
    sums = groups.groupBy("o_custkey", F.get("g", F.lit(0)).alias("rank")).agg(F.sum(total).alias("total"))
    return sums.groupBy("o_custkey").agg(F.max("total").alias("best"))


# CSV
def _csv_texts(spark, sf_dir, broken: bool) -> DataFrame:
    """Ten customers a text, the name with a comma, quotes and a line end; in each seventh row the key may be no number."""
    key = F.col("c_custkey").cast("string")
    key = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("x"), key)).otherwise(key) if broken else key
    line = F.concat(key, F.lit(',"'), F.col("c_name"), F.lit(', ""the\nfirst""",'), F.col("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select((F.col("c_custkey") / 10).cast("bigint").alias("file"), F.struct("c_custkey", line.alias("line")).alias("r"))
    joined = rows.groupBy("file").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return joined.select("file", F.array_join(F.col("r.line"), "\r\n").alias("text"))


CUSTOMER_CSV = (C.u64("key"), C.string("name"), C.string("segment"))


@query("""SELECT c_custkey AS key, c_name || ', "the' || chr(10) || 'first"' AS name, c_mktsegment AS segment FROM customer""")
def csv_roundtrip(spark, sf_dir):
    rows = C.decode_rows(_csv_texts(spark, sf_dir, False), "text", CUSTOMER_CSV)
    return rows.select(F.col("val.key").cast("bigint").alias("key"), "val.name", "val.segment")


@query(
    """SELECT c_custkey // 10 AS file, c_custkey % 10 + 1 AS record_no, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS key,
    CASE WHEN c_custkey % 7 = 0 THEN 'ParsingFailure' END AS error_kind FROM customer"""
)
def csv_errors(spark, sf_dir):
    rows = C.decode_rows(_csv_texts(spark, sf_dir, True), "text", CUSTOMER_CSV)
    return rows.select("file", "record_no", F.col("val.key").cast("bigint").alias("key"), F.col("error.kind").alias("error_kind"))


@query(
    """SELECT c_custkey // 10 AS file, min(CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 10 + 1 END) AS first_bad,
    CASE WHEN count(*) FILTER (c_custkey % 7 = 0) = 0 THEN count(*) END AS records FROM customer GROUP BY 1"""
)
def csv_failfast_first(spark, sf_dir):
    r = C.decode_text("text", CUSTOMER_CSV)
    return _csv_texts(spark, sf_dir, True).select("file", r["error"]["record"].alias("first_bad"), F.when(r["val"].isNotNull(), F.size(r["val"])).cast("bigint").alias("records"))


@query("SELECT page_id, CASE page_id % 4 WHEN 1 THEN '\"b' WHEN 2 THEN chr(9) || 'c' WHEN 3 THEN chr(13) || 'd' END AS left_over FROM pages")
def csv_syntax_errors(spark, sf_dir):
    kind = F.col("page_id") % 4
    text = F.when(kind == 1, F.lit('a,"b')).when(kind == 2, F.lit("b\tc")).when(kind == 3, F.lit("c\rd")).otherwise(F.lit("a,b"))
    return table(spark, sf_dir, "pages").select("page_id", C.csv_records(text)["error"]["message"].alias("left_over"))


# HTTP
def _request_text() -> F.Column:
    n = F.col("page_id").cast("string")
    return F.concat(F.when(F.col("page_id") % 2 == 0, "GET").otherwise("POST"), F.lit(" "), F.col("url"), F.lit(" HTTP/1.1\r\nHost: example.com\r\nX-Page: "), n, F.lit("\r\n\r\nbody "), n)


@query(
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, url AS uri, 1 AS major, 1 AS minor,
    2 AS headers, 'body ' || page_id AS body FROM pages"""
)
def http_request(spark, sf_dir):
    v = http.http_request(_request_text())["val"]
    return table(spark, sf_dir, "pages").select(
        "page_id", v["method"].alias("method"), v["uri"].alias("uri"), v["version"]["major"].cast("int").alias("major"), v["version"]["minor"].cast("int").alias("minor"),
        F.size(v["headers"]).alias("headers"), F.decode(v["body"], "UTF-8").alias("body"),
    )


@query(
    """SELECT page_id, 0 AS ord, 'Host' AS name, 'example.com' AS value FROM pages
    UNION ALL SELECT page_id, 1, 'X-Page', CAST(page_id AS VARCHAR) FROM pages"""
)
def http_headers(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(http.http_request(_request_text())["val"]["headers"]).alias("ord", "h"))
    return rows.select("page_id", "ord", "h.name", "h.value")


@query("SELECT page_id, CAST((page_id + 65536) % 65536 AS INTEGER) AS status_code, 'Fine Page' AS status, url AS location FROM pages")
def http_response_wrap(spark, sf_dir):
    text = F.concat(F.lit("HTTP/1.1 "), (F.col("page_id") + 65536).cast("string"), F.lit(" Fine Page\r\nLocation: "), F.col("url"), F.lit("\r\n\r\n"))
    v = http.http_response(F.encode(text, "UTF-8"), binary=True)["val"]
    return table(spark, sf_dir, "pages").select("page_id", v["status_code"].alias("status_code"), v["status"].alias("status"), F.get(v["headers"], F.lit(0))["value"].alias("location"))


# YAML
@query("SELECT event_id, 'k' AS key, 'int' AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS int_v FROM events")
def yaml_props(spark, sf_dir):
    nodes = yaml.yaml_nodes(table(spark, sf_dir, "events"), "props", "event_id")
    return nodes.where("depth = 1").select("event_id", "key", "kind", "int_v")


def _region_yaml(spark, sf_dir) -> DataFrame:
    item = F.concat(F.lit("  - name: "), F.col("n_name"), F.lit("\n    id: "), F.col("n_nationkey").cast("string"))
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", item.alias("item")))).alias("items"))
    joined = table(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"))
    text = F.concat(F.lit("---\nregion: '"), F.col("r_name"), F.lit("' # the name\nnations:\n"), F.array_join(F.col("items.item"), "\n"), F.lit("\n..."))
    return joined.select("r_regionkey", text.alias("text"))


@query("SELECT n_regionkey AS r_regionkey, n_nationkey AS id, n_name AS name FROM nation")
def yaml_nested(spark, sf_dir):
    parsed = _region_yaml(spark, sf_dir).select("r_regionkey", F.filter(yaml.yaml_parse("text")["nodes"], lambda n: n["depth"] == 3).alias("n"))
    # the fields of an item stay beside each other in the array: no shuffle brings them together
    field = lambda key: F.filter("n", lambda x: x["key"] == key)
    pairs = F.zip_with(field("id"), field("name"), lambda i, n: F.struct(i["int_v"].cast("int").alias("id"), n["str_v"].alias("name")))
    return parsed.select("r_regionkey", F.explode(pairs).alias("p")).select("r_regionkey", "p.id", "p.name")


_SCALARS = {"null": "null", "~": "null", "True": "bool", "-12": "int", "+7": "int", "99999999999999999999": "error", "1.5e3": "float", "1.2.3": "error", ".inf": "string", "yes": "string", "0x1F": "string", "2024-01-01": "string"}


@query("SELECT n_nationkey, text, kind FROM nation, (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _SCALARS.items()) + ") AS s(text, kind)")
def yaml_scalars(spark, sf_dir):
    # a stated list of twelve literals for each row
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, _SCALARS))).alias("text"))
    nodes = yaml.yaml_nodes(rows, "text", "n_nationkey", "text")
    return nodes.select("n_nationkey", "text", "kind")


_YAML_BAD = {"a: 1\na: 2": (2, 1), "root:\n\tchild: 1": (2, 1), "v: &x 1": (1, 3), "a: 1\n---\nb: 2": (2, 1), "v: [1, 2": (1, 3), "  a: 1": (1, 1)}


@query("SELECT n_nationkey, i, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col FROM nation, (VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(_YAML_BAD.values())) + ") AS e(i, line, col)")
def yaml_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(F.array(*map(F.lit, _YAML_BAD))).alias("i", "text"))
    nodes = yaml.yaml_nodes(rows, "text", "n_nationkey", "i").where("kind = 'error'")
    return nodes.select("n_nationkey", "i", F.col("error.line").alias("line"), F.col("error.col").alias("col"))


# XML
def _navs(spark, sf_dir) -> DataFrame:
    """All menus of each page, as one element."""
    found = F.regexp_extract_all("html", F.lit(r"(?s)(<nav>.*?</nav>)"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("<navs>"), F.array_join(found, ""), F.lit("</navs>")).alias("nav"))


def _nav_links(spark, sf_dir) -> DataFrame:
    parsed = _navs(spark, sf_dir).select("page_id", xml.xml_parse("nav")["nodes"].alias("nodes"))
    anchors = F.filter("nodes", lambda n: n["name"] == "a")
    texts = F.filter("nodes", lambda n: n["kind"] == "text")
    row = F.zip_with(anchors, texts, lambda a, t: F.struct(F.get(a["attrs"], F.lit(0))["value"].alias("href"), t["text"].alias("label")))
    return parsed.select("page_id", F.posexplode(row).alias("ord", "r")).select("page_id", "ord", "r.href", "r.label")


_NAV_SQL = r"""SELECT page_id, CAST(i AS INTEGER) AS ord, h[i + 1] AS href, l[i + 1] AS label FROM (
    SELECT page_id, h, l, unnest(range(len(h))) AS i FROM (
      SELECT page_id, regexp_extract_all(nav, '<a href="([^"]*)"', 1) AS h, regexp_extract_all(nav, '<a href="[^"]*">([^<]*)<', 1) AS l
      FROM (SELECT page_id, array_to_string(regexp_extract_all(html, '<nav>.*?</nav>', 0, 's'), '') AS nav FROM pages)))"""


@query(_NAV_SQL)
def xml_nav_links(spark, sf_dir):
    return _nav_links(spark, sf_dir)


@query(
    r"""SELECT page_id, name, depth, n FROM (SELECT page_id, len(navs) AS c, len(regexp_extract_all(array_to_string(navs, ''), '<a ')) AS a FROM
    (SELECT page_id, regexp_extract_all(html, '<nav>.*?</nav>', 0, 's') AS navs FROM pages)),
    LATERAL (VALUES ('navs', 0, 1), ('nav', 1, c), ('ul', 2, c), ('li', 3, a), ('a', 4, a)) AS v(name, depth, n) WHERE n > 0"""
)
def xml_depth(spark, sf_dir):
    nodes = xml.xml_nodes(_navs(spark, sf_dir), "nav", "page_id", kinds=("element",))
    return nodes.groupBy("page_id", "name", "depth").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, 'error' AS kind, 'ParsingFailure' AS error_kind FROM pages")
def xml_reject(spark, sf_dir):
    nodes = xml.xml_nodes(table(spark, sf_dir, "pages"), "html", "page_id")
    return nodes.select("page_id", "kind", F.col("error.kind").alias("error_kind"))


def _supplier_xml() -> F.Column:
    return F.concat(
        F.lit("<?xml version='1.0' encoding=\"utf-8\"?>\n<supplier key=\""), F.col("s_suppkey").cast("string"), F.lit("\" nation = '"), F.col("s_nationkey").cast("string"),
        F.lit("'>\n  <name><![CDATA["), F.col("s_name"), F.lit(" <&>]]></name>\n  <active/>\n</supplier>\n"),
    )


@query("SELECT s_suppkey, 0 AS version_minor, 'utf-8' AS encoding, CAST(s_suppkey AS VARCHAR) AS key, CAST(s_nationkey AS VARCHAR) AS nation, s_name || ' <&>' AS name, 7 AS nodes FROM supplier")
def xml_roundtrip(spark, sf_dir):
    p = F.col("p")
    parsed = table(spark, sf_dir, "supplier").select("s_suppkey", xml.xml_decl(_supplier_xml()).alias("d"), xml.xml_parse(_supplier_xml()).alias("p"))
    root = F.get(p["nodes"], F.lit(0))["attrs"]
    cdata = F.get(F.filter(p["nodes"], lambda n: (n["depth"] == 2)), F.lit(0))["text"]
    return parsed.select(
        "s_suppkey", F.col("d.version_minor").cast("int").alias("version_minor"), "d.encoding", F.get(root, F.lit(0))["value"].alias("key"),
        F.get(root, F.lit(1))["value"].alias("nation"), cdata.alias("name"), F.size(p["nodes"]).alias("nodes"),
    )


# Markdown
@query("SELECT doc_id, doc_id % 6 + 1 AS level, 'Document ' || doc_id AS text, CASE WHEN doc_id % 6 + 1 <= 2 THEN 2 ELSE 1 END AS headings FROM documents")
def md_headings(spark, sf_dir):
    level, name = F.col("doc_id") % 6 + 1, F.concat(F.lit("Document "), F.col("doc_id").cast("string"))
    under = F.when(level == 1, F.lit("\n\nSecond\n===")).when(level == 2, F.lit("\n\nSecond\n---")).otherwise(F.lit(""))
    texts = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), name, F.lit(" ##"), under).alias("text"))
    parsed = texts.select("doc_id", markdown.md_parse("text").alias("p"))
    return parsed.select(
        "doc_id", F.get(F.col("p.blocks"), F.lit(0))["level"].cast("bigint").alias("level"), F.get(F.col("p.inlines"), F.lit(0))["text"].alias("text"), F.size("p.blocks").alias("headings")
    )


@query(
    """SELECT doc_id, CAST(lines AS INTEGER) AS blocks, 'paragraph' AS kind FROM
    (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda line: trim(line) <> '')) AS lines FROM documents) WHERE lines > 0"""
)
def md_blocks_count(spark, sf_dir):
    # a blank line after each line makes it a paragraph of its own
    texts = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    nodes = markdown.md_blocks(texts, "text", "doc_id", max_depth=0)
    return nodes.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("blocks"), F.min("kind").alias("kind"))


@query(
    """SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS row_no, CAST(n_nationkey AS VARCHAR) AS id, n_name AS name
    FROM nation"""
)
def md_tables(spark, sf_dir):
    line = F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), F.replace(F.col("n_name"), F.lit("_"), F.lit(r"\_")), F.lit(" |"))
    lines = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))).alias("rows"))
    texts = lines.select("n_regionkey", F.concat(F.lit("| id | name |\n| ---: | :--- |\n"), F.array_join(F.col("rows.line"), "\n")).alias("text"))
    parsed = texts.select("n_regionkey", markdown.md_parse("text").alias("p"))
    words = F.map_from_entries(F.transform("p.inlines", lambda n: F.struct(n["block_node_id"], n["text"])))
    cells = parsed.select("n_regionkey", words.alias("words"), F.explode(F.filter("p.blocks", lambda b: b["kind"] == "table_cell")).alias("c"))
    return cells.groupBy("n_regionkey", F.col("c.row_no").cast("bigint").alias("row_no")).agg(
        F.max(F.when(F.col("c.cell_no") == 0, F.element_at("words", F.col("c.node_id")))).alias("id"), F.max(F.when(F.col("c.cell_no") == 1, F.element_at("words", F.col("c.node_id")))).alias("name")
    )


@query(
    """SELECT p_partkey, 'ordered' AS list_kind, p_size AS list_start, p_partkey % 2 = 0 AS loose, CASE WHEN p_partkey % 3 = 0 THEN 'checked' ELSE 'unchecked' END AS task,
    2 AS items, 1 AS nested FROM part"""
)
def md_lists(spark, sf_dir):
    gap = F.when(F.col("p_partkey") % 2 == 0, F.lit("\n\n")).otherwise(F.lit("\n"))
    mark = F.when(F.col("p_partkey") % 3 == 0, F.lit("[x] ")).otherwise(F.lit("[ ] "))
    size = F.col("p_size").cast("string")
    pad = F.repeat(F.lit(" "), F.length(size) + 2)
    text = F.concat(size, F.lit(". "), mark, F.col("p_name"), gap, size, F.lit(") "), F.col("p_brand"), F.lit("\n"), pad, F.lit("- "), F.col("p_type"))
    b = F.col("b")
    parsed = table(spark, sf_dir, "part").select("p_partkey", markdown.md_parse(text, want="blocks")["blocks"].alias("b"))
    first = F.get(b, F.lit(0))
    items = F.filter(b, lambda x: (x["kind"] == "list_item") & (x["depth"] == 1))
    return parsed.select(
        "p_partkey", first["list_kind"].alias("list_kind"), first["list_start"].cast("int").alias("list_start"), first["loose"].alias("loose"),
        F.get(items, F.lit(0))["task"].alias("task"), F.size(items).alias("items"), F.size(F.filter(b, lambda x: (x["kind"] == "list_item") & (x["depth"] == 3))).alias("nested"),
    )


@query(
    """SELECT page_id, 'link' AS kind, n AS ord, url AS href, CASE WHEN n IN (0, 1) THEN 'the page' END AS title FROM pages, (VALUES (0), (1), (2), (3)) AS v(n)
    UNION ALL SELECT page_id, 'image', 4, url, NULL FROM pages"""
)
def md_links(spark, sf_dir):
    url = F.col("url")
    text = F.concat(F.lit("See [one]("), url, F.lit(' "the page"), [two][Ref], <'), url, F.lit("> and "), url, F.lit(" ![pic]("), url, F.lit(")\n\n[ref]: "), url, F.lit(" 'the page'"))
    nodes = markdown.md_inlines(table(spark, sf_dir, "pages").select("page_id", text.alias("text")), "text", "page_id", max_depth=0)
    linked = nodes.where(F.col("kind").isin("link", "image"))
    order = (F.row_number().over(Window.partitionBy("page_id").orderBy("node_id")) - 1).alias("ord")
    return linked.select("page_id", "kind", order, "href", "title")


@query(
    """SELECT p_partkey, k.kind AS kind, CASE k.kind WHEN 'strong' THEN p_name WHEN 'emphasis' THEN p_brand WHEN 'strikethrough' THEN p_type ELSE CAST(p_size AS VARCHAR) END AS text
    FROM part, (VALUES ('strong'), ('emphasis'), ('strikethrough'), ('code')) AS k(kind)"""
)
def md_inline_marks(spark, sf_dir):
    text = F.concat(F.lit("**"), F.col("p_name"), F.lit("** and _"), F.col("p_brand"), F.lit("_, ~~"), F.col("p_type"), F.lit("~~ `"), F.col("p_size").cast("string"), F.lit("`"))
    nodes = table(spark, sf_dir, "part").select("p_partkey", markdown.md_parse(text, want="inlines")["inlines"].alias("n"))
    marked = F.filter("n", lambda x: (x["depth"] == 0) & (x["kind"] != "text"))
    inner = lambda x: F.get(F.filter("n", lambda y: (y["depth"] == 1) & (y["parent_id"] == x["node_id"])), F.lit(0))["text"]
    rows = nodes.select("p_partkey", F.explode(F.transform(marked, lambda x: F.struct(x["kind"].alias("kind"), F.coalesce(x["text"], inner(x)).alias("text")))).alias("r"))
    return rows.select("p_partkey", "r.kind", "r.text")


@query(
    """SELECT p_partkey, 0 AS ord, 'sql' AS info, 'SELECT ' || p_size || ';' || chr(10) || chr(10) || '-- ' || p_name || chr(10) AS raw FROM part
    UNION ALL SELECT p_partkey, 1, '', p_brand || chr(10) FROM part"""
)
def md_code_blocks(spark, sf_dir):
    text = F.concat(F.lit("~~~~ sql\nSELECT "), F.col("p_size").cast("string"), F.lit(";\n\n-- "), F.col("p_name"), F.lit("\n~~~~~\n    "), F.col("p_brand"))
    nodes = markdown.md_blocks(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "text", "p_partkey", kinds=("code",))
    return nodes.select("p_partkey", "ord", "info", "raw")


@query("SELECT o_orderkey, o_custkey AS customer, o_orderstatus AS status, o_orderkey % 2 = 0 AS even FROM orders")
def md_frontmatter_yaml(spark, sf_dir):
    text = F.concat(
        F.lit("---\ncustomer: "), F.col("o_custkey").cast("string"), F.lit("\nstatus: \""), F.col("o_orderstatus"), F.lit('"\neven: '),
        (F.col("o_orderkey") % 2 == 0).cast("string"), F.lit("\n---\n# Order\n"),
    )
    parsed = table(spark, sf_dir, "orders").select("o_orderkey", yaml.yaml_parse(markdown.md_frontmatter(text))["nodes"].alias("n"))
    field = lambda key: F.get(F.filter("n", lambda x: x["key"] == key), F.lit(0))
    return parsed.select("o_orderkey", field("customer")["int_v"].alias("customer"), field("status")["str_v"].alias("status"), field("even")["bool_v"].alias("even"))


@query(
    """SELECT page_id, url AS href, 'Page ' || page_id AS label, CASE WHEN page_id % 2 = 0 THEN 'two words' END AS title, page_id % 6 + 1 AS level, 'code ' || page_id || chr(10) AS pre FROM pages"""
)
def md_standalone(spark, sf_dir):
    n = F.col("page_id").cast("string")
    title = F.when(F.col("page_id") % 2 == 0, F.lit(' "two words"')).otherwise(F.lit(""))
    link = markdown.md_link(F.concat(F.lit("[Page "), n, F.lit("]("), F.col("url"), title, F.lit(")")))
    head = markdown.md_heading(F.concat(F.repeat(F.lit("#"), (F.col("page_id") % 6 + 1).cast("int")), F.lit(" Page "), n, F.lit(" #")))
    code = markdown.md_code(F.concat(F.lit("```py\ncode "), n, F.lit("\n```")))
    return table(spark, sf_dir, "pages").select(
        "page_id", link["href"].alias("href"), head["content"].alias("label"), link["title"].alias("title"), head["level"].cast("bigint").alias("level"), code["pre"].alias("pre")
    )


@query(
    """SELECT n_nationkey, 'HEADING: Two ' || n_name || chr(10) || 'PARAGRAPH: see **bold** [x](/' || n_nationkey || ')' || chr(10) || 'LIST unordered loose=false:' || chr(10)
    || '- none' || chr(10) || 'PARAGRAPH: one' || chr(10) || '- none' || chr(10) || 'PARAGRAPH: two' || chr(10) AS outline FROM nation"""
)
def md_outline(spark, sf_dir):
    text = F.concat(F.lit("## "), F.replace(F.col("n_name"), F.lit("_"), F.lit(r"\_")), F.lit("\nsee **bold** [x](/"), F.col("n_nationkey").cast("string"), F.lit(")\n- one\n- two"))
    return table(spark, sf_dir, "nation").select("n_nationkey", markdown.md_render(text).alias("outline"))


# parsed output inside relational plans
@query(f"SELECT p.page_id, p.url, count(n.href) AS links FROM pages p LEFT JOIN ({_NAV_SQL}) n ON p.page_id = n.page_id GROUP BY p.page_id, p.url")
def join_parsed(spark, sf_dir):
    links = _nav_links(spark, sf_dir).groupBy("page_id").agg(F.count("href").alias("links"))
    return table(spark, sf_dir, "pages").select("page_id", "url").join(links, "page_id", "left").withColumn("links", F.coalesce("links", F.lit(0)))


@query(f"SELECT href, page_id, ord, row_number() OVER (PARTITION BY href ORDER BY page_id, ord) AS seen FROM ({_NAV_SQL})")
def window_parsed(spark, sf_dir):
    seen = F.row_number().over(Window.partitionBy("href").orderBy("page_id", "ord")).cast("bigint")
    return _nav_links(spark, sf_dir).select("href", "page_id", "ord", seen.alias("seen"))


@query(
    """SELECT event_type, CAST(user_id % 10 AS BIGINT) AS bucket, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n
    FROM events GROUP BY ROLLUP (event_type, user_id % 10)"""
)
def rollup_parsed(spark, sf_dir):
    k = parse_column("props", PROPS)["val"]["k"].cast("bigint")
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("bucket"), k.alias("k"))
    return rows.rollup("event_type", "bucket").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT c_custkey, c_name, 'Customer' AS word, CAST(substr(c_name, 10) AS BIGINT) AS number FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"""
)
def anti_join_parsed(spark, sf_dir):
    named = g.record().keep("word", g.take_until("#")).skip(g.lit("#")).keep("number", g.digits())
    v = parse_column("c_name", named)["val"]
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", v["word"].alias("word"), v["number"].cast("bigint").alias("number"))
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return rows.join(urgent, "c_custkey", "left_anti")
