"""The corpus pipeline: each stage on its own input, and all of them."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomtext.llm import language_id, pii, queries, toxicity
from loomtext.llm.common import held_out, table


@pytest.fixture(scope="module")
def stages():
    return dict(corpus_pipeline.STAGES)


def test_the_pipeline_packs_what_the_stages_keep(spark, sf_dir, stages, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts, names = [docs.count()], docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == names
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.select("doc_id").distinct().count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.7 * counts[0] and counts[3] < counts[2] <= counts[1]
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.select("doc_id").distinct().count() == counts[-1]
    key = lambda df: sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in df.collect())
    assert key(whole) == key(docs)


def test_stages_are_those_of_plain_code(spark, sf_dir, stages):
    docs = table(spark, sf_dir, "documents").limit(120)
    docs = docs.unionByName(spark.createDataFrame([(-1, "12 34", None, None, 5), (-2, None, None, None, None)], docs.schema))
    rows = {r["doc_id"]: r for r in docs.collect()}
    scored = language_id.predict_language(docs, language_id.fit_prototypes(docs, key="doc_id"), ["doc_id"], n_grams=True).collect()
    want = {r["doc_id"] for r in scored if r["lang_pred"] != "und" and r["score"] >= 0.15 - 0.4 / max(1, r["n_grams"]) ** 0.5}
    assert {r["doc_id"] for r in stages["language"](spark, docs, sf_dir).collect()} == want and -1 not in want and -2 not in want
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1)))
    want = {i for i, r in rows.items() if model.score([r["text"] or ""])[0] < 0.7}
    assert {r["doc_id"] for r in stages["toxicity"](spark, docs, sf_dir).collect()} == want
    for r in stages["personal_data"](spark, docs, sf_dir).collect():
        old = rows[r["doc_id"]]["text"]
        text = old and pii.redact(old, pii.find(old))
        assert (r["text"], r["n_chars"]) == (text, rows[r["doc_id"]]["n_chars"] if text == old else len(text))
    packed = stages["packing"](spark, docs, sf_dir).toPandas()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, own in packed.groupby("doc_id"):
        ids = [*library.encode(rows[i]["text"] or "", add_special_tokens=False).ids, 1]
        assert own.length.sum() == len(ids) and set(zip(own.start, own.ids_crc32)) == {(a, zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for a in range(0, len(ids), 2048)}
    # one group here: first-fit decreasing over all pieces
    order = packed.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
    room, want = [], []
    for n in order.length:
        b = next((k for k, free in enumerate(room) if free >= n), len(room))
        if b == len(room):
            room.append(2048)
        want.append((b, 2048 - room[b]))
        room[b] -= n
    assert list(zip(order.sequence_id, order.offset)) == want


COLUMNS = {
    "op1": "query_id bigint, rank int, vec_id bigint, score bigint", "op2": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op3": "doc_id bigint, held_out boolean, lang_pred string, score double", "op4": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op5": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean", "op6": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op7": "doc_id bigint, held_out boolean, score double, predicted int", "op8": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op9": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int", "op10": "page_id bigint, url string, text string, n_chars bigint",
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_have_the_columns_and_rows_of_their_contract(spark, sf_dir, name):
    out = queries.QUERIES[name](spark, sf_dir)
    own = COLUMNS[name.split("_")[0]]
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema.fields) == own
    of = {"op1": None, "op2": None, "op8": "embeddings", "op10": "pages"}.get(name.split("_")[0], "documents")
    assert out.count() == table(spark, sf_dir, of).count() if of else out.count() > 0


def test_stages_on_edge_rows(spark, sf_dir, stages, edges, nothing):
    n = edges.count()
    for name, stage in stages.items():
        if name != "packing":
            out = stage(spark, edges, sf_dir)
            assert out.columns == edges.columns and out.count() <= n
        assert stage(spark, nothing, sf_dir).count() == 0
    kept = [r["doc_id"] for r in stages["language"](spark, edges, sf_dir).collect()]
    assert 2 not in kept and 3 not in kept and 1 in kept
    unlabelled = stages["language"](spark, edges.withColumn("lang", F.lit(None).cast("string")), sf_dir)
    assert sorted(r["doc_id"] for r in unlabelled.where("doc_id is not null").collect()) == [1, 1, 5, 6]
    deduped = stages["near_dedup"](spark, edges, sf_dir)
    assert deduped.where("doc_id = 1").count() == 1 and deduped.where("doc_id is null").count() == 2


def test_near_dedup_keeps_one_of_each_group(spark, sf_dir, stages):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(3, base), (1, base), (2, base.replace("w59", "x")), (9, "other words stand here alone and apart"), (8, base.replace("w1 ", "y "))]
    kept = stages["near_dedup"](spark, spark.createDataFrame(rows, "doc_id bigint, text string"), sf_dir)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 9]


def test_personal_data_is_gone(spark, sf_dir, stages):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = stages["personal_data"](spark, docs, sf_dir)
    left = pii.find_documents(clean)
    assert left.agg(F.sum(F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone"))).first()[0] == 0
    assert clean.where(F.length("text") != F.col("n_chars")).count() == docs.where(F.length("text") != F.col("n_chars")).count()


def test_near_dedup_treats_rows_without_an_id_alike(spark, sf_dir, stages):
    rows = [(None, "one text without any id"), (None, "one text without any id"), (4, "some other words stand here"), (4, "some other words stand here")]
    for some, n in ((rows, 3), (rows[:3], 3)):
        kept = stages["near_dedup"](spark, spark.createDataFrame(some, "doc_id bigint, text string"), sf_dir)
        assert kept.where("doc_id is null").count() == 2 and kept.count() == n


def test_a_short_text_in_no_learned_language_goes(spark, sf_dir, stages):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    russian = "Утром мы вышли из дома и долго шли вдоль реки, пока не увидели старый мост, за которым начинался лес, и там решили отдохнуть до самого вечера."
    rows = [(-1, russian, None), (-2, russian * 2, None), (-3, russian[:60], None), (-4, "ok", None)]
    kept = stages["language"](spark, docs.union(spark.createDataFrame(rows, docs.schema)), sf_dir)
    assert [r["doc_id"] for r in kept.where("doc_id < 0").collect()] == [-4]
