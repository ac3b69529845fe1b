"""Near-duplicate embeddings with spherical-cap filters.

The filter directions are random product codes: the (rotated) space is cut into blocks,
each with its own random codebook, and a direction is one codeword from each block.  A
vector passes every filter whose direction it meets at or over one fixed height, the same for all
vectors of a length; these are found by list decoding (block by block, partial sums pruned
by the best that the other blocks can add), never by trying all directions.  A vector that
passes none links with nothing but its equals; REPEATS independent codes make that rare.  Vectors sharing a
filter and a label are compared exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import batches_of, checkpoint, resident, table, tidy
from loomtext.llm.components import COMPONENTS_SQL, connected_components, union_find

#: Filters that a vector passes in each code, on average; recall by cosine and codebook size is in the README.
FILTERS = 32
REPEATS = 2
#: Directions of a code for each vector of the largest label: unrelated vectors then rarely share one.
DIRECTIONS_PER_VECTOR = 640
#: Codewords of a block; where two blocks of as many give too few directions, there are more blocks.
MOST_WORDS = 1 << 15
LEAST_WORDS = 64
THRESHOLD = 0.98
GROUP = 512


def code_shape(vectors: int) -> tuple[int, int]:
    """(blocks, codewords of each) for a label with so many vectors: the directions grow with them without a bound."""
    wanted, blocks = DIRECTIONS_PER_VECTOR * max(1, vectors), 2
    while MOST_WORDS**blocks < wanted:
        blocks += 1
    return blocks, max(LEAST_WORDS, int(np.ceil(wanted ** (1 / blocks))))


def cap_height(dim: int, share: float) -> float:
    """The inner product with a fixed direction that this share of all directions reaches."""
    if dim == 1:
        return 0.0
    angle = np.linspace(0, np.pi, 100_001)
    weight = np.sin(angle) ** (dim - 2)
    area = np.concatenate(([0], np.cumsum((weight[1:] + weight[:-1]) / 2)))
    return float(np.cos(np.interp(min(1.0, share), area / area[-1], angle)))


class Filters:
    """The product codes for one dimension."""

    def __init__(self, dim: int, blocks: int, size: int):
        self.m, self.size = min(blocks, dim), size
        self.height = np.float32(cap_height(dim, FILTERS / size**self.m))
        self.cuts = np.linspace(0, dim, self.m + 1).round().astype(int)
        self.codes = []
        for repeat in range(REPEATS):
            random = np.random.Generator(np.random.PCG64([dim, self.m, size, repeat]))
            rotation = np.linalg.qr(random.standard_normal((dim, dim)))[0]
            words = []
            for a, b in zip(self.cuts, self.cuts[1:]):
                c = random.standard_normal((size, b - a))
                # a block's words are turned back into the space: one product gives a vector's scores
                words.append((rotation[:, a:b] @ (c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(self.m)).T).astype(np.float32))
            self.codes.append(words)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Sorted filters of each unit vector: all directions that it meets at or over the height."""
        unit = unit.astype(np.float32)
        out: list[list[np.ndarray]] = [[] for _ in unit]
        rows = max(1, (4 << 20) // (self.size * self.m))  # scores in hand at a time
        for repeat, words in enumerate(self.codes):
            first = repeat * self.size**self.m
            for at in range(0, len(unit), rows):
                scores = [unit[at : at + rows] @ w for w in words]
                best = [s.max(axis=1) for s in scores]
                for v in range(len(scores[0])):
                    sums, ids = np.zeros(1, np.float32), np.zeros(1, np.int64)
                    for b, s in enumerate(scores):
                        need = self.height - sum(x[v] for x in best[b + 1 :])
                        words_left = np.flatnonzero(s[v] >= need - sums.max())
                        both = sums[:, None] + s[v][words_left][None, :]
                        x, y = np.nonzero(both >= need)
                        sums, ids = both[x, y], ids[x] * self.size + words_left[y]
                        if not len(ids):
                            break
                    out[at + v].append(ids + first)
        return [np.sort(np.concatenate(x)) for x in out]


def filters(dim: int, blocks: int, size: int) -> Filters:
    made = resident("caps", dict)
    if (dim, blocks, size) not in made:
        if len(made) >= 8:
            made.clear()
        made[dim, blocks, size] = Filters(dim, blocks, size)
    return made[dim, blocks, size]


def _unit(data: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(data), "<f8").reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(batches):
    """(id, label, dim, f1, f2, data) of the vectors that can link; f1 and f2 say label, length and content."""
    for batch in batches:
        out = {n: [] for n in ("id", "label", "dim", "f1", "f2", "data")}
        for i, label, v in zip(*(c.to_pylist() for c in batch.columns)):
            if i is None or label is None or not v or None in v:
                continue
            x = np.array(v, "<f8") + 0.0
            if not np.isfinite(x).all() or not x.any():
                continue
            d = xxhash.xxh3_128_digest(x.tobytes() + label.encode("utf-8", "surrogatepass"), seed=len(x))
            for n, value in zip(out, (i, label, len(x), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), x.tobytes())):
                out[n].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("id", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64()), ("data", pa.binary())]))


#: Columns of a row to compare: a bucket (label, length, filter) and a pair of its blocks, then a node.
_PLACE = ("label", "dim", "f", "lo", "hi")
_NODE = ("side", "f1", "f2", "rep", "copies", "data", "filters")


def _compare(threshold: float):
    """For each block pair, link sums (f1, f2, links) and a spanning forest (a, b) over the nodes' smallest ids."""
    schema = pa.schema([("f1", pa.int64()), ("f2", pa.int64()), ("links", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def block(place, rows):
        rows = sorted(rows, key=lambda r: r[0])
        split = sum(r[0] == 0 for r in rows)
        f1, f2, rep, copies = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3, 4))
        unit, own = _unit([r[5] for r in rows], place[1]), place[2]
        lists = [np.frombuffer(r[6], "<i8") for r in rows]
        two = split < len(rows)
        left, right = np.arange(split), np.arange(split, len(rows)) if two else np.arange(split)
        near = unit[left] @ unit[right].T >= threshold
        if not two:
            near &= left[:, None] < right[None, :]
        if near.any():
            # a pair counts in the smallest filter that both have, and nowhere else
            li, ri = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            rows_l, rows_r = left[li], right[ri]
            lower = [x[x < own] for x in lists]
            common = np.intersect1d(np.concatenate([lower[i] for i in rows_l]), np.concatenate([lower[i] for i in rows_r]))
            if len(common):
                a, b = np.zeros((len(rows_l), len(common)), np.float32), np.zeros((len(rows_r), len(common)), np.float32)
                for m, which in ((a, rows_l), (b, rows_r)):
                    for k, i in enumerate(which):
                        m[k, np.searchsorted(common, np.intersect1d(lower[i], common, assume_unique=True))] = 1
                near[np.ix_(li, ri)] &= a @ b.T == 0
        x, y = np.nonzero(near)
        if not len(x):
            return None
        x, y = left[x], right[y]
        links = np.bincount(x, copies[y], len(rows)) + np.bincount(y, copies[x], len(rows))
        forest = [(i, r) for i, r in union_find(zip(rep[x].tolist(), rep[y].tolist())).items() if i != r]
        some = np.flatnonzero(links)
        empty, none = [None] * len(some), [None] * len(forest)
        columns = ([*f1[some].tolist(), *none], [*f2[some].tolist(), *none], [*links[some].astype(np.int64).tolist(), *none], [*empty, *(f[0] for f in forest)], [*empty, *(f[1] for f in forest)])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    def run(batches):
        at, rows, n = None, [], len(_PLACE)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:n] != at:
                    if len(rows) > 1 and (out := block(at, rows)):
                        yield out
                    at, rows = row[:n], []
                rows.append(row[n:])
        if len(rows) > 1 and (out := block(at, rows)):
            yield out

    return tidy(run)


def near_duplicate_embeddings(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) of each row.

    Vectors link when labels are equal and their cosine in double precision is at least
    ``threshold``.  Equal vectors of a label are one node with a count; the rest of a
    bucket is compared in blocks of ``GROUP`` that emit link sums and a spanning
    forest, so a large group costs no row a pair.  Null, zero or non-finite vectors,
    null labels and null ids link with nothing (0 links, their own component, kept).
    Vectors of different lengths never link.  Rows with one id count as separate vectors
    in one component.  Empty table: no rows.  Other columns are not read.
    """
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    with batches_of(vectors.sparkSession, 2000):
        valid = checkpoint(rows.mapInArrow(tidy(_vectors), "id bigint, label string, dim int, f1 bigint, f2 bigint, data binary"))
        nodes = checkpoint(valid.groupBy("f1", "f2").agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("data").alias("data")))
        found = _links(nodes, threshold)
    links = found.where("links is not null").groupBy("f1", "f2").agg(F.sum("links").alias("links"))
    # components over ids: a node stands for its smallest id, and an id of several vectors joins their nodes
    several = valid.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    repeated = valid.join(several, "id", "left_semi").select("id", "f1", "f2").join(nodes.select("f1", "f2", "rep"), ["f1", "f2"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    component = connected_components(found.where("a is not null").select("a", "b").union(repeated)).withColumnRenamed("node", "rep")
    by_node = nodes.select("f1", "f2", "rep", "copies").join(links, ["f1", "f2"], "left").join(component, "rep", "left")
    by_node = by_node.select("f1", "f2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    linked = valid.select("id", "f1", "f2").join(by_node, ["f1", "f2"]).select("id", "n_links", "component")
    return _with_the_rest(rows, linked)


def _links(nodes: DataFrame, threshold: float) -> DataFrame:
    """What ``_compare`` says of all buckets, written out."""
    largest = nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    blocks, size = code_shape(largest)

    def decode(batches):
        for batch in batches:
            dims = np.array(batch.column(2).to_pylist())
            data, out = batch.column(3).to_pylist(), [b""] * batch.num_rows
            for dim in np.unique(dims):
                which = np.flatnonzero(dims == dim)
                for i, f in zip(which, filters(int(dim), blocks, size).decode(_unit([data[i] for i in which], int(dim)))):
                    out[i] = f.astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary()), pa.array([np.frombuffer(o, "<i8") for o in out], pa.list_(pa.int64()))], names=["f1", "f2", "filters", "each"])

    decoded = checkpoint(nodes.select("f1", "f2", "dim", "data").mapInArrow(tidy(decode), "f1 bigint, f2 bigint, filters binary, each array<bigint>"))
    named = decoded.join(nodes, ["f1", "f2"])
    passed = named.select("f1", "f2", "label", "dim", F.explode("each").alias("f"))
    # most filters are passed by one vector: they go before anything else is fetched
    bucket = ["label", "dim", "f"]
    shared = passed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = passed.join(shared.select(*bucket, F.ceil(F.col("n") / GROUP).cast("int").alias("parts")), bucket).withColumn("own", F.pmod(F.xxhash64("f1", F.lit(9)), F.col("parts")).cast("int"))
    paired = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "f1", "f2", *bucket, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side")
    )
    full = paired.join(named.select("f1", "f2", "rep", "copies", "data", "filters"), ["f1", "f2"]).select(*_PLACE, *_NODE)
    dealt = full.repartition(*_PLACE).sortWithinPartitions(*_PLACE)
    return checkpoint(dealt.mapInArrow(_compare(threshold), "f1 bigint, f2 bigint, links bigint, a bigint, b bigint"))


def _with_the_rest(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows that cannot link, added with no links; a valid row is one ``linked`` has."""
    from pyspark.sql import types as T

    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    some = F.exists("v", lambda x: x != F.lit(0))
    ok = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & some, F.lit(False))
    rest = rows.where(~ok).select("id", F.lit(0).cast(T.LongType()).alias("n_links"), F.col("id").alias("component"))
    return linked.union(rest).select("id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_embeddings(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


#: All pairs of a label; for tables whose vec_id is unique.
OP8_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL
), valid AS (
  SELECT vec_id, label, len(e) AS dim, e FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM valid x JOIN valid y ON x.label = y.label AND x.dim = y.dim AND x.vec_id < y.vec_id
  WHERE CASE WHEN x.dim = y.dim THEN list_cosine_similarity(x.e, y.e) >= 0.98 ELSE false END
), {COMPONENTS_SQL},
counted AS (SELECT a AS node, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(vec_id = coalesce(component, vec_id), true) AS kept
FROM embeddings LEFT JOIN smallest ON smallest.node = vec_id LEFT JOIN counted ON counted.node = vec_id
"""
