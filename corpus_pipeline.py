"""The corpus pipeline: language, toxicity, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import checkpoint, held_out, sieve, table
from loomtext.llm.language_id import UNDETERMINED, fit_prototypes, predict_language
from loomtext.llm.minhash import near_duplicates
from loomtext.llm.packing import pack_documents
from loomtext.llm.pii import redact_documents
from loomtext.llm.toxicity import fit, score_documents

#: A text with a cosine under LEAST_COSINE - SPREAD / sqrt(n-grams) to every learned language is in none of them.
LEAST_COSINE, SPREAD = 0.15, 0.4

#: Classifiers, signatures and tokenizers have no SQL form; tests compare each stage with a plain version.
ORACLE_SQL = None


def _rows(docs: DataFrame) -> DataFrame:
    """Whole rows as one column: columns of any name pass through an operator unharmed."""
    return docs.select(F.struct(*docs.columns).alias("row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those unlike every learned language, the shorter the more unlike; where no language is known, only the former.

    Null and empty texts have no letter and go; repeated rows share one fate; long texts are
    read whole; ties between languages do not matter.  Empty table: no rows.  Columns named
    like the operator's own pass through.
    """
    prototypes = fit_prototypes(docs, key="doc_id")
    if not prototypes:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    scored = predict_language(_rows(docs), prototypes, ["row"], text="row.text", n_grams=True)
    unlike = F.col("score") < LEAST_COSINE - SPREAD / F.sqrt("n_grams")
    return scored.where((F.col("lang_pred") != UNDETERMINED) & ~F.coalesce(unlike, F.lit(False))).select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents predicted toxic.

    A null or empty text is scored as an empty one; repeated rows share one fate; long texts
    are read whole.  Empty table, or no labels: a constant score.  Columns named like the
    operator's own pass through.
    """
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1)))
    return score_documents(_rows(docs), model, ["row"], text="row.text").where("predicted = 0").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates (five words, 0.8); of rows with one doc_id and one text, one.

    Rows without a doc_id all stay, and so do different texts under one doc_id that stays.
    A null, empty or blank text is in no group.  Empty table: no rows.
    """
    gone = checkpoint(near_duplicates(docs).where(~F.col("kept")).select(F.col("id").alias("doc_id")).distinct())
    maybe, others = sieve(docs, gone, "doc_id")
    kept = maybe.join(gone, "doc_id", "left_anti").select(*docs.columns).union(others)
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(kept.where("doc_id is null"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the text; n_chars follows.

    Every row stays: a null text null, an empty one empty, repeated rows alike, long texts
    whole, other columns untouched.  Of overlapping spans the first names the replacement.
    """
    return redact_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 2048 tokens.

    A null or empty text is its end id alone; repeated rows are packed each; long texts are
    cut into pieces; pieces of equal length go by id.  Empty table: no rows.  Other columns
    are not read.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("toxicity", toxicity), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage keeps is written once, since the next one reads it several times."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
