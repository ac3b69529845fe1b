"""Near-duplicate documents: MinHash signatures joined within a Hamming radius.

A text's shingle set gives a signature of K symbols of b bits.  Two signatures at
most r symbols apart agree, in at least one of m chunks, up to the few errors that
the pigeonhole principle leaves to a chunk; each chunk is therefore indexed with
every allowed choice of wrong places left out, and equal keys meet.  All pairs
within the radius share a key.  Links are confirmed on the full shingle sets.

Buckets are never expanded into pairs.  First every member meets only one member of its
bucket, the leader; confirmed links give components.  Then only the members of a
leader's buckets that are still in different components are compared, in blocks bounded
by rows and by the size of their sets: a first pass over signatures finds the members
with anyone near in another component, and only their full sets are sent on to a second
pass, which confirms the links and emits no more than a spanning forest.  Pairs left out
either lie in one component already or are beyond the radius, so components are those of
all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from loomtext.llm.common import HOT_SHARE, SALTS, batches_of, checkpoint, hot_join, hot_keys, sieve, table, tidy
from loomtext.llm.components import COMPONENTS_SQL, connected_components

SYMBOLS = 64
#: A pair at similarity 0.8 differs in 12.8 of 64 symbols on average (deviation 3.2) and in more than 27 with a chance of 1.4 in 100,000.
RADIUS = 27
CHUNKS = 14
WORDS = 5
PERCENT = 80
#: Expected members of a block, and hashes of their sets: the memory of a comparing task, however large a group is.
BLOCK, BLOCK_HASHES = 2048, 1 << 20
#: Rows of an Arrow batch: texts and sets are long.
BATCH_ROWS = 1000
#: One in so many distinct sets is looked at to find hot bucket keys.
SAMPLED = 64
_RANDOM = np.random.Generator(np.random.PCG64(20))
_FACTORS = _RANDOM.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)


_BYTES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        both.append(np.cumprod(p, dtype=np.uint64))
    return both[0], both[1]


_POWERS = _powers(1 << 15)


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of each run of bytes without ASCII white space: a polynomial in random byte values, taken from prefix sums."""
    codes = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([False], ~_SPACE[codes], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    if not len(edges):
        return np.zeros(0, np.uint64)
    up, down = _POWERS if len(codes) < len(_POWERS[0]) else _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_BYTES[codes] * up[: len(codes)], out=sums[1:])
    start, end = edges[::2], edges[1::2]
    out = (sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    Words are maximal runs without ASCII white space, A-Z lower-cased.  Fewer words
    than a shingle make one shingle; no words, none.
    """
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(h):
        return h
    size = min(words, len(h))
    n = len(h) - size + 1
    out = np.full(n, size * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(size):
        out ^= h[i : i + n]
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Low 16 bits of the least value of each permutation."""
    least = np.full(SYMBOLS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 1024):
        block = np.multiply.outer(_FACTORS, hashes[at : at + 1024])
        block ^= _SHIFTS[:, None]
        np.minimum(least, block.min(axis=1), out=least)
    return (least & np.uint64(0xFFFF)).astype("<u2")


def chunk_plans(symbols: int = SYMBOLS, radius: int = RADIUS, chunks: int = CHUNKS) -> list[np.ndarray]:
    """Places kept by each key.

    With radius = chunks * e + a, two signatures within the radius have at most e errors in
    one of the first a + 1 chunks, or at most e - 1 in one of the others.
    """
    e, a = divmod(radius, chunks)
    bounds = np.linspace(0, symbols, chunks + 1).round().astype(int)
    out = []
    for c in range(chunks):
        places = range(bounds[c], bounds[c + 1])
        errors = e if c <= a else e - 1
        if errors >= 0:
            out += [np.array([p for p in places if p not in wrong]) for wrong in combinations(places, min(errors, len(places) - 1))]
    return out


def chunk_keys(signatures: np.ndarray, plans: list[np.ndarray]) -> np.ndarray:
    """(rows, keys) of int64."""
    out = np.empty((len(signatures), len(plans)), np.uint64)
    wide = signatures.astype(np.uint64)
    for j, places in enumerate(plans):
        h = np.full(len(wide), (j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for p in places:
            h ^= wide[:, p]
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
        out[:, j] = h
    return out.view(np.int64)


def describe(docs: DataFrame, *, key: str, text: str, words: int) -> DataFrame:
    """(id, n, f1, f2, sig): size, fingerprint and signature of each row's shingle set."""

    def run(batches):
        for batch in batches:
            n, f1, f2, sig = [], [], [], []
            for t in batch.column(1).to_pylist():
                s = shingles(t, words)
                d = xxhash.xxh3_128_digest(s.astype("<u8").tobytes())
                n.append(len(s))
                f1.append(int.from_bytes(d[:8], "little", signed=True))
                f2.append(int.from_bytes(d[8:], "little", signed=True))
                sig.append(signature(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary())], names=["id", "n", "f1", "f2", "sig"])

    return docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).mapInArrow(tidy(run), "id bigint, n bigint, f1 bigint, f2 bigint, sig binary")


def full_sets(ids: DataFrame, docs: DataFrame, *, key: str, text: str, words: int) -> DataFrame:
    """(id, s): the shingle sets of the documents ``ids``, made again from their whole texts."""

    def sets(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, words).astype("<u8").tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "s"])

    texts, _ = sieve(docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")), ids, "id")
    return texts.join(ids, "id", "left_semi").distinct().mapInArrow(tidy(sets), "id bigint, s binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, hot: DataFrame) -> DataFrame:
    """Those (a, b) of ``pairs`` whose full shingle sets have 100 * |both| >= percent * |either|; ``hot`` names the a with very many b."""

    def judge(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                small, large = (x, y) if len(x) < len(y) else (y, x)
                ok = len(small) > 0 and 100 * len(small) >= percent * len(large)
                if ok:
                    at = np.searchsorted(large, small)
                    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                    ok = 100 * both >= percent * (len(x) + len(y) - both)
                keep.append(ok)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    right = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    full = hot_join(right, sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a", "b", hot)
    return full.select("a", "b", "x", "y").mapInArrow(tidy(judge), "a bigint, b bigint")


class _Block:
    """Members of one leader in one block pair."""

    def __init__(self, rows: list, percent: int):
        self.rows, self.own, self.percent = rows, rows[0][0], percent
        self.side, self.ids, comp, self.n = (np.array([r[i] for r in rows], np.int64) for i in (3, 4, 5, 6))
        self.sig = np.frombuffer(b"".join(r[7] for r in rows), "<u2").reshape(len(rows), SYMBOLS)
        self.lower = [{x for x in r[8] if x < self.own} for r in rows]
        self.label = np.unique(comp, return_inverse=True)[1].ravel()

    def near(self):
        """(i, those near i that are in other components now); a pair counts under the smallest leader that both have.

        Members of the most common component are met from the other side only.
        """
        two = (self.side == 1).any()
        for i in np.flatnonzero(self.label != np.bincount(self.label).argmax()):
            if self.ids[i] == self.own:  # the leader has met everyone
                continue
            ok = (self.label != self.label[i]) & (self.ids != self.own) & (100 * np.minimum(self.n, self.n[i]) >= self.percent * np.maximum(self.n, self.n[i]))
            if two:
                ok &= self.side != self.side[i]
            found = np.flatnonzero(ok)
            found = found[(self.sig[found] != self.sig[i]).sum(axis=1) <= RADIUS]
            if self.lower[i]:
                found = np.array([j for j in found if self.lower[i].isdisjoint(self.lower[j])], np.int64)
            if len(found):
                yield i, found

    def survivors(self) -> list:
        """Rows with anyone near."""
        kept = np.zeros(len(self.rows), bool)
        for i, found in self.near():
            kept[i] = True
            kept[found] = True
        return [self.rows[i] for i in np.flatnonzero(kept)]

    def forest(self) -> list[tuple[int, int]]:
        """Confirmed links that join components, each joining once."""
        hashes = [np.frombuffer(r[9], "<u8") for r in self.rows]
        lengths = np.array([len(h) for h in hashes])
        starts = np.concatenate(([0], np.cumsum(lengths)))
        dense = np.unique(np.concatenate(hashes), return_inverse=True)[1].ravel().astype(np.int32)
        flag = np.zeros(int(dense.max()) + 1 if len(dense) else 1, bool)
        out, label = [], self.label
        for i, found in self.near():
            for at in range(0, len(found), 64):
                some = found[at : at + 64]
                some = some[label[some] != label[i]]
                if not len(some):
                    continue
                flag[dense[starts[i] : starts[i + 1]]] = True
                hit = flag[np.concatenate([dense[starts[j] : starts[j + 1]] for j in some])]
                both = np.add.reduceat(hit, np.concatenate(([0], np.cumsum(lengths[some])[:-1])), dtype=np.int64)
                flag[dense[starts[i] : starts[i + 1]]] = False
                for j in some[100 * both >= self.percent * (lengths[i] + lengths[some] - both)]:
                    if label[j] != label[i]:
                        out.append((int(self.ids[i]), int(self.ids[j])))
                        label[label == label[j]] = label[i]
        return out


def _by_block(judge, schema: pa.Schema):
    """Calls ``judge(rows)`` for each block pair of rows sorted by (leader, lo, hi), which are its first columns."""

    def run(batches):
        at, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != at:
                    if len(rows) > 1:
                        yield made(judge(rows))
                    at, rows = row[:3], []
                rows.append(row)
        if len(rows) > 1:
            yield made(judge(rows))

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return tidy(run)


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row.

    Sets that are equal are one node from the start, so exact copies cost one
    aggregation.  Empty sets (null or blank text) and null ids link with nothing; a null
    id has a null component and is kept.  Rows with one id are one node.  Empty
    table: no rows.  Other columns are not read.
    """
    if percent < 80:
        raise ValueError("the radius is set for similarities of 0.8 and more")
    with batches_of(docs.sparkSession, BATCH_ROWS):
        described, final = _classes_and_components(docs, key=key, text=text, words=words, percent=percent)
    linked = described.select("id", F.col("n").alias("n_shingles"), F.when(F.expr("n > 0 and id is not null"), F.col("f1")).alias("f1"), F.when(F.expr("n > 0"), F.col("f2")).alias("f2"))
    out = linked.join(final, ["f1", "f2"], "left").withColumn("component_id", F.coalesce("component", "id"))
    return out.select("id", "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _meetings(classes: DataFrame) -> DataFrame:
    """(leader, id): each distinct set with the leader, in general the smallest member, of every bucket that it shares.

    Keys go through one shuffle, in which hot buckets are salted: a sample of the sets finds
    them (a bounded list, which misses only buckets too small to matter), and since any member
    will do to meet the others, the smallest of the sample stands for the smallest of all.
    """
    plans = chunk_plans()

    def keyed(batches):
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, SYMBOLS)
                for at in range(0, len(sig), 1000):
                    k = chunk_keys(sig[at : at + 1000], plans)
                    yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(np.repeat(np.array(batch.column(0).slice(at, 1000).to_pylist(), np.int64), k.shape[1]))], names=["k", "id"])

    def keys(rows):
        return rows.select("rep", "sig").mapInArrow(tidy(keyed), "k bigint, id bigint")

    seen = keys(classes.where(F.pmod(F.xxhash64("f1", F.lit(19)), F.lit(SAMPLED)) == 0)).groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("chosen"))
    seen = checkpoint(seen)
    total = seen.agg(F.sum("size").alias("total"))
    # at most HOT_SHARE * len(plans) rows
    hot = seen.where("size > 16").join(F.broadcast(total)).where(F.col("size") * HOT_SHARE * len(plans) > F.col("total")).select("k", "chosen")
    salt = F.when(F.col("chosen").isNotNull(), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(SALTS))).otherwise(F.lit(0))
    dealt = keys(classes).join(F.broadcast(hot), "k", "left").select("k", "id", "chosen", salt.alias("salt"))
    met = dealt.select("id", F.coalesce("chosen", F.min("id").over(Window.partitionBy("k", "salt"))).alias("leader"))
    return met.where("id <> leader").select("leader", "id").distinct()


def _classes_and_components(docs: DataFrame, *, key: str, text: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Described rows, and the component of each distinct set; both written out."""
    described = checkpoint(describe(docs, key=key, text=text, words=words))
    classes = described.where("n > 0 and id is not null").groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.min("sig").alias("sig"))
    classes = checkpoint(classes)
    met = checkpoint(_meetings(classes))
    hot = checkpoint(hot_keys(met.groupBy("leader").agg(F.count(F.lit(1)).alias("size")), "leader"))
    hot_a = hot.withColumnRenamed("leader", "a")
    light = classes.select(F.col("rep").alias("id"), "n", "sig")
    stars = checkpoint(_plausible(met.select(F.col("leader").alias("a"), F.col("id").alias("b")), light, percent, hot_a))
    sets = checkpoint(full_sets(met.select("id").union(met.select("leader")).distinct(), docs, key=key, text=text, words=words))
    first = checkpoint(connected_components(confirm(stars, sets, percent, hot_a)))

    # what is left: leaders whose members are in more than one component
    members = met.union(met.select("leader", "leader").distinct()).join(light, "id")
    placed = checkpoint(members.join(first.withColumnRenamed("node", "id"), "id", "left").select("leader", "id", "n", "sig", F.coalesce("component", "id").alias("comp")))
    still = placed.groupBy("leader").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("hashes")).where("lo <> hi and size > 2")
    parts = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("hashes") / BLOCK_HASHES)).cast("int")
    apart = checkpoint(hot_join(placed, still.select("leader", parts.alias("parts")), "leader", "id", hot))
    nodes = apart.groupBy("id").agg(F.collect_set("leader").alias("leaders"))  # one for each key of a signature at most
    own = F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")).cast("int")
    paired = apart.join(nodes, "id").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "leader", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "comp", "n", "sig", "leaders"
    )
    block, shape = ["leader", "lo", "hi"], "leader bigint, lo int, hi int, side int, id bigint, comp bigint, n bigint, sig binary, leaders array<bigint>"
    in_blocks = lambda rows: rows.repartition(*block).sortWithinPartitions(*block)
    close = in_blocks(paired).mapInArrow(_by_block(lambda rows: _Block(rows, percent).survivors(), to_arrow_schema(paired.schema)), shape)
    full = in_blocks(checkpoint(close).join(sets, "id").select(*paired.columns, "s"))
    more = full.mapInArrow(_by_block(lambda rows: _Block(rows, percent).forest(), pa.schema([("a", pa.int64()), ("b", pa.int64())])), "a bigint, b bigint")
    named = first.withColumnRenamed("node", "id")
    bridges = (
        more.join(named.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left")
        .join(named.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    )
    second = connected_components(bridges).select(F.col("node").alias("c1"), F.col("component").alias("c2"))
    final = (
        classes.select("f1", "f2", F.col("rep").alias("id"))
        .join(named, "id", "left").select("f1", "f2", F.coalesce("component", "id").alias("c1"))
        .join(second, "c1", "left").select("f1", "f2", F.coalesce("c2", "c1").alias("component"))
    )
    return described, _one_id_one_component(described, checkpoint(final))


def _plausible(pairs: DataFrame, light: DataFrame, percent: int, hot: DataFrame) -> DataFrame:
    """Pairs (a, b) within the radius whose set sizes allow the similarity."""

    def near(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, SYMBOLS) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((x != y).sum(axis=1) <= RADIUS))

    one = pairs.join(light.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("y")), "b")
    two = hot_join(one, light.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("x")), "a", "b", hot)
    return two.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "x", "y").mapInArrow(near, "a bigint, b bigint")


def _one_id_one_component(described: DataFrame, final: DataFrame) -> DataFrame:
    """Rows of one id with different sets are one node: their components join."""
    several = described.where("n > 0 and id is not null").groupBy("id").agg(F.min(F.struct("f1", "f2")).alias("lo"), F.max(F.struct("f1", "f2")).alias("hi")).where("lo <> hi").select("id")
    if several.isEmpty():
        return final
    rows = described.join(several, "id", "left_semi").where("n > 0").select("id", "f1", "f2").join(final, ["f1", "f2"]).select("id", "component")
    least = rows.groupBy("id").agg(F.min("component").alias("least"))
    merged = connected_components(rows.join(least, "id").select(F.col("component").alias("a"), F.col("least").alias("b")))
    return final.join(merged.select(F.col("node").alias("component"), F.col("component").alias("c3")), "component", "left").select("f1", "f2", F.coalesce("c3", "component").alias("component"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4).withColumnRenamed("id", "doc_id")


#: Full sets of all documents: equal ones are one node, others are counted by the shingles they share.
OP5_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1), lambda i: md5(array_to_string(w[i : i + 3], ' '))))) AS s FROM words
), named AS (
  SELECT doc_id, len(s) AS n, s, CASE WHEN len(s) > 0 AND doc_id IS NOT NULL THEN min(doc_id) OVER (PARTITION BY s) END AS rep FROM sets
), nodes AS (
  SELECT rep, any_value(n) AS n, any_value(s) AS s FROM named WHERE rep IS NOT NULL GROUP BY rep, s
), shared AS (
  SELECT rep, n, unnest(s) AS g FROM nodes
), links AS (
  SELECT x.rep AS a, y.rep AS b FROM shared x JOIN shared y ON x.g = y.g AND x.rep < y.rep GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
  UNION SELECT doc_id, rep FROM named WHERE doc_id <> rep
), {COMPONENTS_SQL}
SELECT doc_id, n AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(doc_id = coalesce(component, doc_id), true) AS kept
FROM named LEFT JOIN smallest ON node = doc_id
"""
