"""Driver contract, oracles, SQL names, sources and streaming."""

import glob
import importlib
import math
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomtext.functions.registry import register
from loomtext.operators import grammar as g
from loomtext.operators import parse_column
from loomtext.plans import more_queries, parser_queries  # noqa: F401  (registers its queries)
from loomtext.sources import read_binary, read_parquet, read_texts, write_table
from loomtext.streaming import parse_stream, sum_by_window


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", list(parser_queries.ORACLE_SQL))
def test_query_matches_its_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {path.split('/')[-1][:-8]} AS SELECT * FROM '{path}'")
    got = parser_queries.QUERIES[name](spark, sf_dir)
    want = con.execute(parser_queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    flat = lambda cols, rows: sorted(tuple(normal(r[cols.index(c)]) for c in order) for r in rows)
    assert flat(got.columns, [tuple(r) for r in got.collect()]) == flat(names, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_imports_without_the_training_data_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("loomtext.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "loomtext.llm", None)
    try:
        entry = importlib.reload(__spark_entry__)
        assert "props_by_type" in entry.queries() and "pipeline" not in entry.queries()
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)


def test_regular_parses_stay_inside_code_generation(spark, sf_dir):
    plan = parser_queries.QUERIES["props_by_type"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    scan = [line for line in plan.splitlines() if "ReadSchema" in line][0]
    assert "event_type" in scan and "user_id" not in scan


def test_sql_names(spark):
    register(spark)
    spark.createDataFrame(
        [(1, "<a x='1'><b>t</b></a>", "k: [1, 2]", "# H *e*", 'a,"b\nc"\nd'), (2, "<a", "k: [", "```", '"x'), (3, None, None, None, None)], "i int, x string, y string, m string, c string"
    ).createOrReplaceTempView("docs")
    rows = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert rows("SELECT i, kind, name, text FROM docs, LATERAL xml_nodes(x) ORDER BY i, node_id") == [(1, "element", "a", None), (1, "element", "b", None), (1, "text", None, "t"), (2, "error", None, None)]
    assert rows("SELECT i, kind, int_v FROM docs, LATERAL yaml_nodes(y) ORDER BY i, node_id") == [(1, "mapping", None), (1, "sequence", None), (1, "int", 1), (1, "int", 2), (2, "error", None)]
    assert rows("SELECT i, kind, level FROM docs, LATERAL md_blocks(m) ORDER BY i, node_id") == [(1, "heading", 1), (2, "error", None)]
    assert rows("SELECT i, kind, text FROM docs, LATERAL md_inlines(m) ORDER BY i, node_id")[:3] == [(1, "text", "H "), (1, "emphasis", None), (1, "text", "e")]
    assert rows("SELECT i, record_no, fields, error.kind FROM docs, LATERAL csv_rows(c) ORDER BY i, record_no") == [(1, 1, ["a", "b\nc"], None), (1, 2, ["d"], None), (2, None, None, "SyntaxError")]
    assert rows("SELECT yaml_debug(y) FROM docs WHERE i = 1") == [('Mapping([{ key: "k", value: Sequence([Int(1), Int(2)]) }])',)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"1,2\n")
    (tmp_path / "b.txt").write_bytes(b"\xff\x00")
    texts = read_texts(spark, str(tmp_path), pattern="*.csv").collect()
    assert [r["text"] for r in texts] == ["1,2\n"] and texts[0]["path"].endswith("a.csv")
    assert bytes(read_binary(spark, str(tmp_path), pattern="*.txt").first()["content"]) == b"\xff\x00"
    write_table(spark.range(4).withColumn("p", F.col("id") % 2), str(tmp_path / "out"), partition_by=["p"])
    back = read_parquet(spark, str(tmp_path / "out"), ["id", "p"])
    assert back.where("p = 1").count() == 2


def test_streaming_parse(spark, tmp_path, sf_dir):
    source = str(tmp_path / "in")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "props").limit(200).cache()
    events.union(events.select("ts", F.lit("broken")).limit(3)).repartition(3).write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, props string").option("maxFilesPerTrigger", 1).parquet(source)
    good, bad = parse_stream(stream, parse_column("props", parser_queries.PROPS), keep=("ts",))
    for df, name, want in ((good, "good", 200), (bad, "bad", 3)):
        df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        assert spark.table(name).count() == want
    sums = sum_by_window(good.select("ts", F.col("val.k").cast("bigint").alias("k")), "ts", F.col("k"), every="1 hour", late="10 minutes")
    sums.writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    total = events.select(F.sum(parse_column("props", g.record().skip(g.lit('{"k": ')).keep("k", g.digits()).skip(g.lit("}")))["val"]["k"]).cast("bigint")).first()[0]
    assert spark.table("sums").agg(F.sum("total")).first()[0] == total
