"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import checkpoint


def union_find(pairs) -> dict[int, int]:
    """Smallest member of each node's component."""
    parent: dict[int, int] = {}

    def root(x):
        r = x
        while parent.setdefault(r, r) != r:
            r = parent[r]
        while parent[x] != r:
            parent[x], x = r, parent[x]
        return r

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def _forest(batches):
    """Edges of each Arrow batch (of bounded size) as stars around its local minima."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        found = [(x, r) for x, r in union_find(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())).items() if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], schema=schema)


def _to_minimum(edges: DataFrame) -> DataFrame:
    """(a, b, m): each directed edge with the least of a and its b; sums before the shuffle, so a hub is no hot task."""
    least = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return edges.join(least, "a")


def connected_components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b long); component is its smallest node.

    Each round is checkpointed; the number of edges never grows and rounds are
    logarithmic in the nodes in practice.  Nodes without an edge to another node do
    not appear; an empty input gives no rows.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b").mapInArrow(_forest, "a bigint, b bigint")
    edges = checkpoint(edges.distinct())
    for _ in range(max_rounds):
        both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        # a star has one edge a leaf, and its centre is no leaf
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("leaf"), F.lit(0).alias("hub")), F.struct(F.col("b").alias("n"), F.lit(0).alias("leaf"), F.lit(1).alias("hub")))).alias("e")).select("e.*")
        uneven = ends.groupBy("n").agg(F.sum("leaf").alias("leaf"), F.max("hub").alias("hub")).where("leaf > 1 or (leaf > 0 and hub > 0)")
        if uneven.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        large = _to_minimum(edges.select(F.explode(both).alias("e")).select("e.*")).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = _to_minimum(large)
        edges = checkpoint(small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


#: Common table expressions (to follow WITH RECURSIVE): from ``links`` (a, b), every node reached and the smallest one.
COMPONENTS_SQL = """
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reached r JOIN both_ways e ON r.b = e.a),
smallest AS (SELECT a AS node, least(a, min(b)) AS component FROM reached GROUP BY a)
"""
