"""Exact top-k by inner product without random access.

Candidates are dealt to blocks; a block keeps one sorted list for each component.  A
query reads its lists from the better end (by the sign of its own component) in
small steps and keeps, for each candidate, the sum of what has been read: the unread rest of a
list can add at most its next value (upper bound) and at least its last one (lower
bound).  Candidates whose upper bound is under the k-th lower bound, or under the k-th score of
another block, drop out; reading stops when no more than k are left or the lists end, and only
the scores of those are resolved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm.common import checkpoint, table, tidy

K = 5
SCALE = 256
#: Candidates of a block and queries of a chunk: the memory of a task, whatever the table.
BLOCK = 8192
CHUNK = 512
#: Steps in which a list is read: bounds are looked at after each.
STEPS = 16
_LARGEST = float(1 << 62)


class Lists:
    """Sorted lists of one block, and each candidate's place in them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        columns = np.ascontiguousarray(vectors.T)
        self.order = np.argsort(columns, axis=1, kind="stable")
        self.values = np.take_along_axis(columns, self.order, axis=1).astype(np.float64)
        self.place = np.empty(vectors.shape, np.uint16 if len(ids) < 1 << 16 else np.int32)
        np.put_along_axis(self.place.T, self.order, np.arange(len(ids), dtype=self.place.dtype)[None, :], axis=1)
        self.largest = np.abs(self.values).max(axis=1) if len(ids) else np.zeros(len(columns))
        self.depth_read = 0

    def top(self, query: np.ndarray, own: int, k: int, floor: float = -np.inf) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id; scores under ``floor`` may be left out."""
        size = len(self.ids)
        q = query.astype(np.float64)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        # the bounds' single-precision sums may be off by this much
        most = float(np.abs(q) @ self.largest)
        slack, kind = 1.5e-7 * (len(q) + 2) * most + 1e-9, np.float32 if most < 1e30 else np.float64
        last = np.concatenate((self.values[up, 0] * q[up], self.values[down, -1] * q[down]))
        read = np.zeros(size)
        left = np.flatnonzero(self.ids != own)
        depths = [-(-size * step // STEPS) for step in range(1, STEPS + 1)]
        # the next values after each depth: no upper bound is under their sum
        inside = np.array(depths[:-1], np.int64)
        nexts = np.concatenate((self.values[np.ix_(up, size - inside - 1)] * q[up, None], self.values[np.ix_(down, inside)] * q[down, None]))
        sums = [*nexts.sum(axis=0).tolist(), -np.inf]
        signs = np.concatenate((up, down))

        def bounds(rows, depth, ahead):
            """(lower, upper) of some candidates when the lists are read to that depth."""
            places = self.place[rows]
            # unread places of a list: from low on, under high
            low, high = np.zeros(len(q), places.dtype), np.zeros(len(q), places.dtype)
            high[up], low[down], high[down] = size - depth, depth, size
            rest = np.zeros((len(q), 2), kind)
            rest[signs, 0], rest[signs, 1] = last, ahead
            return (read[rows][:, None] + ((places >= low) & (places < high)).astype(kind) @ rest).T

        done = 0
        for step, depth in enumerate(depths):
            if len(left) <= k:
                break
            # bounds cannot tell anyone apart from the floor before this depth, so the parts up to it are read in one go
            if depth == done or (sums[step] >= floor > -np.inf):
                continue
            # the next part of each list, best values first
            for lists, part in ((up, slice(size - depth, size - done)), (down, slice(done, depth))):
                for j in lists.tolist():
                    read[self.order[j, part]] += self.values[j, part] * q[j]
            done = depth
            ahead = last if depth == size else nexts[:, step]
            # looking at all costs as much as reading: where some tell that few would drop out, more is read first
            some = left[::32]
            if depth < size and len(some) > 32 and floor > -np.inf and (bounds(some, depth, ahead)[1] + slack >= floor).mean() > 0.6:
                continue
            lower, upper = bounds(left, depth, ahead)
            floor = max(floor, float(np.partition(lower, len(left) - k)[len(left) - k]) - slack)
            left = left[upper + slack >= floor]
        self.depth_read = done
        scores = self.vectors[left] @ query
        best = np.lexsort((self.ids[left], -scores))[:k]
        return [(int(scores[i]), int(self.ids[left[i]])) for i in best]


def _prepare(scale: int):
    def run(batches):
        for batch in batches:
            ids, dims, data = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not v or None in v:
                    continue
                x = np.array(v, np.float64)
                if np.isfinite(x).all():
                    ids.append(i)
                    dims.append(len(x))
                    data.append(np.clip(np.floor(scale * x), -_LARGEST, _LARGEST).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], names=["id", "dim", "data"])

    return run


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def answer(lists, rows):
        out: tuple[list, list, list] = ([], [], [])
        for row in rows:
            for score, found in lists.top(np.frombuffer(row[4], "<i8"), row[3], k, -np.inf if row[5] is None else float(row[5])):
                for o, v in zip(out, (row[3], found, score)):
                    o.append(v)
        return pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], schema=schema)

    def run(batches):
        # a block's candidates (kind 0) come before the queries that it meets (kind 1)
        at, candidates, lists = None, [], None
        for batch in batches:
            queries = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != at:
                    if queries:
                        yield answer(lists, queries)
                    at, candidates, lists, queries = row[:2], [], None, []
                if row[2] == 0:
                    candidates.append(row)
                    continue
                if lists is None and candidates:
                    lists = Lists(np.array([c[3] for c in candidates], np.int64), np.frombuffer(b"".join(c[4] for c in candidates), "<i8").reshape(len(candidates), -1))
                    candidates = []
                if lists is not None:
                    queries.append(row)
                if len(queries) == CHUNK:
                    yield answer(lists, queries)
                    queries = []
            if queries:
                yield answer(lists, queries)

    return run


def top_k_search(vectors: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best other candidates by the inner product of floor(scale * x).

    Ties go to the smaller id.  Null vectors, those with null or non-finite components and
    null ids take no part, and vectors meet only those of their own length.  A row that is
    repeated is one candidate with that many places.  Fewer than k candidates: all of
    them.  Empty tables: no rows.  Scores are 64-bit integers; where components are so large that
    one would not fit, it is not defined (components are cut at 2**62).  Other columns are not read.

    Every block of candidates gets the queries once; only k rows a query and block are
    shuffled on.  The first block of each length is searched before the others: its k-th scores
    are floors that let the others stop reading earlier.
    """
    shape = "id bigint, dim int, data binary"
    made = lambda df: df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).mapInArrow(tidy(_prepare(scale)), shape)
    candidates = checkpoint(made(vectors).groupBy("id", "dim", "data").agg(F.count(F.lit(1)).alias("copies")))
    blocks = candidates.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    # a row for each vector length: no more than the longest vector has components, so it is broadcast
    blocks = F.broadcast(checkpoint(blocks))
    asked = checkpoint(made(queries).dropDuplicates(["id", "dim", "data"]))
    dealt = candidates.join(blocks, "dim").select("dim", F.pmod(F.xxhash64("id", "data"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "data", F.lit(None).cast("bigint").alias("floor"))

    def search(sent, candidates):
        rows = candidates.union(sent.select("dim", "block", F.lit(1).alias("kind"), "id", "data", "floor")).repartition("dim", "block").sortWithinPartitions("dim", "block", "kind")
        return rows.mapInArrow(tidy(_search(k)), "query_id bigint, vec_id bigint, score bigint")

    sent = asked.join(blocks, "dim")
    first = checkpoint(search(sent.select("dim", F.lit(0).alias("block"), "id", "data", F.lit(None).cast("bigint").alias("floor")), dealt.where("block = 0")))
    # an id of several query vectors has more rows, and no floor
    floors = first.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") == k).select("id", "floor")
    rest = sent.where("blocks > 1").join(floors, "id", "left").withColumn("block", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)))
    found = first.union(search(rest, dealt.where("block > 0")))
    copies = candidates.groupBy("id").agg(F.max("copies").alias("copies")).where("copies > 1").withColumnRenamed("id", "vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    spread = best.join(copies, "vec_id", "left").withColumn("c", F.explode(F.sequence(F.lit(1), F.least(F.coalesce("copies", F.lit(1)), F.lit(k)))))
    ranked = spread.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k_search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
