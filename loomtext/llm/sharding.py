"""Rendezvous (highest random weight) hashing of stable record keys over weighted shards.

Every row scores its key against each shard with MD5 and goes to the highest
score, so adding a shard only takes rows into the new one.  Everything is a
built-in expression; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm.common import checkpoint, copies, table

#: Hex digits of the slot order that form a bucket: 4,096 buckets a shard are numbered in parallel.
BUCKET_DIGITS = 3


def _score(key: Column, shard: int) -> Column:
    return F.md5(F.concat_ws(":", key, F.lit(str(shard))).cast("binary"))


def rendezvous_shard(key: Column, weights: Sequence[float] | int) -> Column:
    """Shard of ``key``: a count of equal shards, or one positive weight a shard.

    Equal weights compare digests as text (exact everywhere); unequal ones use
    ``-w / ln(u)`` with ``u`` the first 52 bits of the digest in (0, 1).
    Ties go to the smaller shard.  A null key is the key ''.
    """
    key = F.coalesce(key.cast("string"), F.lit(""))
    if isinstance(weights, int):
        weights = [1.0] * weights
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    if len(set(weights)) == 1:
        scores = [_score(key, s) for s in range(len(weights))]
    else:
        scores = [
            F.lit(-float(w)) / F.log((F.conv(F.substring(_score(key, s), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52))
            for s, w in enumerate(weights)
        ]
    pairs = [F.struct(x.alias("h"), F.lit(-s).alias("s")) for s, x in enumerate(scores)]
    return (-(F.greatest(*pairs) if len(pairs) > 1 else pairs[0])["s"]).cast("int")


def shard_documents(docs: DataFrame, shards: int = 40, *, key: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """Law ``key``: the key and the shard count decide the shard.

    Returns key, ``size`` (UTF-8 bytes of the text plus ``overhead``; null: 0
    bytes), ``text_crc32`` (null text: that of the empty text), ``law``,
    ``shard``, ``slot`` (0.. without gaps in each shard) and ``grown_shard``
    (the shard if there were one more).

    Slots follow the order of md5(key:crc:size).  Equal rows are counted before
    the shuffle and expanded last, so neither a repeated row nor a hot shard is
    sorted in one task: a task numbers one (shard, bucket), and bucket offsets
    come from their counts.  Empty input gives no rows; other columns, also ones named
    like an output column, are ignored.
    """
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(key), (F.octet_length(data) + F.lit(overhead)).cast("bigint").alias("size"), F.crc32(data).alias("text_crc32"))
    rows = checkpoint(rows.groupBy(key, "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")))
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    best = F.greatest(*(F.struct(_score(k, s).alias("h"), F.lit(-s).alias("s")) for s in range(shards))) if shards > 1 else F.struct(_score(k, 0).alias("h"), F.lit(0).alias("s"))
    rows = (
        rows.withColumn("best", best)
        .withColumn("shard", (-F.col("best.s")).cast("int"))
        .withColumn("grown_shard", F.when(_score(k, shards) > F.col("best.h"), F.lit(shards)).otherwise(F.col("shard")).cast("int"))
        .withColumn("slot_order", F.md5(F.concat_ws(":", k, F.col("text_crc32"), F.col("size")).cast("binary")))
        .withColumn("bucket", F.substring("slot_order", 1, BUCKET_DIGITS))
        .drop("best")
    )
    counts = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("total"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("bucket_start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("slot_order", key).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, ["shard", "bucket"])
    return copies(placed, "n", "copy").select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("bucket_start") + F.col("start") + F.col("copy")).alias("slot"), "grown_shard"
    )


def op9_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 40)


#: The CRC is taken byte by byte with the table that its polynomial gives.
OP9_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS steps
), d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, encode(coalesce(text, '')) AS data FROM documents
), sized AS (
  SELECT doc_id, k, CAST(octet_length(data) + 16 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(data), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM d, crc
), scored AS (
  SELECT k, CAST(s AS INTEGER) AS s, md5(k || ':' || s) AS h FROM (SELECT DISTINCT k FROM d), range(41) AS shards(s)
), best AS (
  SELECT k, s AS shard, h, row_number() OVER (PARTITION BY k ORDER BY h DESC, s) AS place FROM scored WHERE s < 40
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(k || ':' || text_crc32 || ':' || size), doc_id) - 1 AS slot,
  CASE WHEN one_more.h > best.h THEN 40 ELSE shard END AS grown_shard
FROM sized JOIN best USING (k) JOIN scored AS one_more USING (k) WHERE best.place = 1 AND one_more.s = 40
"""
