"""Operators over many rows, against brute force."""

import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtext.llm import common, embedding_dedup, minhash, queries, sharding, topk
from loomtext.llm.components import connected_components, union_find


def components(nodes, edges):
    roots = union_find([*((n, n) for n in nodes), *edges])
    return {n: roots[n] for n in nodes}


def word_sets(texts, words):
    out = {}
    for i, t in texts.items():
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        out[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    return out


def near_pairs(sets):
    """Links between different sets, and within equal ones to the smallest id."""
    by = defaultdict(list)
    for i, s in sets.items():
        if s:
            by[frozenset(s)].append(i)
    edges = [(min(v), x) for v in by.values() for x in v]
    reps = [(min(v), s) for s, v in by.items()]
    holders = defaultdict(list)
    for k, (_, s) in enumerate(reps):
        both = defaultdict(int)
        for g in s:
            for o in holders[g]:
                both[o] += 1
            holders[g].append(k)
        edges += [(reps[k][0], reps[o][0]) for o, n in both.items() if 100 * n >= 80 * (len(s) + len(reps[o][1]) - n)]
    return edges


def corpus(seed=6):
    """Unrelated texts, exact copies, chains of small changes, and one group of several hundred near copies."""
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(4000))
    texts = [" ".join(word() for _ in range(rng.randrange(3, 120))) for _ in range(150)]
    texts += [rng.choice(texts) for _ in range(60)]
    for base in texts[:25]:
        w = base.split()
        for _ in range(4):
            w = list(w)
            w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    hot = [word() for _ in range(90)]
    for _ in range(900):
        w = list(hot)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    rng.shuffle(texts)
    return {i: t for i, t in enumerate(texts)}


def test_near_duplicates_are_those_of_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    for words in (4, 5):
        sets = word_sets(texts, words)
        want = components(texts, near_pairs(sets))
        got = {r["id"]: r for r in minhash.near_duplicates(df, words=words).collect()}
        assert {i: r["component_id"] for i, r in got.items()} == want
        assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
        assert all(r["kept"] == (i == want[i]) for i, r in got.items())


def test_hot_buckets_and_small_blocks_change_nothing(spark, monkeypatch):
    texts = corpus()
    for name, value in (("SAMPLED", 1), ("HOT_SHARE", 1 << 20), ("BLOCK", 40), ("BLOCK_HASHES", 4000)):
        monkeypatch.setattr(minhash, name, value)
    monkeypatch.setattr(common, "LEAST_HOT", 20)
    monkeypatch.setattr(common, "HOT_SHARE", 1 << 20)
    want = components(texts, near_pairs(word_sets(texts, 5)))
    rows = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert {r["id"]: r["component_id"] for r in rows} == want


def test_a_sieve_loses_nothing(spark):
    rows, ids = spark.range(5000), spark.range(0, 5000, 7)
    inside, outside = common.sieve(rows, ids, "id")
    some, others = {r["id"] for r in inside.collect()}, {r["id"] for r in outside.collect()}
    assert some >= {r["id"] for r in ids.collect()} and len(some) < 1000 and sorted(some | others) == list(range(5000)) and not some & others
    assert common.sieve(rows, ids.limit(0), "id")[1].count() == 5000


def test_copies_are_numbered(spark):
    got = common.copies(spark.createDataFrame([("a", 1), ("b", 10_000)], "k string, n bigint"), "n", "at").groupBy("k").agg(F.count("*").alias("c"), F.countDistinct("at").alias("d"), F.max("at").alias("m"))
    assert {(r["k"], r["c"], r["d"], r["m"]) for r in got.collect()} == {("a", 1, 1, 0), ("b", 10_000, 10_000, 9_999)}


def test_signatures_within_the_radius_always_share_a_key():
    rng, plans = np.random.default_rng(7), minhash.chunk_plans()
    a = rng.integers(0, 1 << 16, (400, minhash.SYMBOLS)).astype("<u2")
    b = a.copy()
    for row in b:
        places = rng.choice(minhash.SYMBOLS, minhash.RADIUS, replace=False)
        row[places] ^= rng.integers(1, 1 << 16, minhash.RADIUS).astype("<u2")
    same = minhash.chunk_keys(a, plans) == minhash.chunk_keys(b, plans)
    assert same.any(axis=1).all()


def test_near_duplicate_edges(spark, edges, nothing):
    rows = minhash.near_duplicates(edges).collect()
    assert len(rows) == edges.count() and minhash.near_duplicates(nothing).count() == 0
    by = {r["id"]: r for r in rows}
    assert by[2]["n_shingles"] == 0 and by[2]["kept"] and by[1]["component_id"] == 1
    assert all(r["kept"] and r["component_id"] is None for r in rows if r["id"] is None)
    # one id with two different texts is one node
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "u v w x y z"), (3, "u v w x y z")], "doc_id bigint, text string")
    assert {r["id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 1}
    with pytest.raises(ValueError):
        minhash.near_duplicates(df, percent=50)


def test_components(spark):
    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(500)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(300)] + [(5, 5), (None, 1)]
    want = {n: c for n, c in union_find([p for p in pairs if None not in p and p[0] != p[1]]).items()}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint").repartition(7)).collect()}
    assert got == want


def vectors(spark, seed=9):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, 2):
        centres = rng.standard_normal((40, 32))
        for _ in range(250):
            c = centres[rng.integers(40)]
            rows.append((len(rows), (c + rng.standard_normal(32) * 0.1 * rng.random()).astype("f4").astype(float).tolist(), label))
    hot = rng.standard_normal(32)
    rows += [(len(rows) + i, (hot + 0.05 * rng.standard_normal(32)).astype("f4").astype(float).tolist(), 1) for i in range(700)]
    rows += [(len(rows) + i, [2.0 * x for x in rows[0][1]], 0) for i in range(30)]
    odd = [None, [], [0.0] * 32, [1.0] * 31 + [None], [float("nan")] * 32, [float("inf")] + [1.0] * 31, [1.0] * 5]
    rows += [(len(rows) + i, v, 0) for i, v in enumerate(odd)]
    rows += [(len(rows), rows[0][1], None)]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, label int, id string, node int")


def test_embedding_links_are_those_of_brute_force(spark):
    rows, df = vectors(spark)
    good = [(i, np.array(v), l) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, edges = defaultdict(int), []
    for k, (i, v, l) in enumerate(good):
        for j, w, m in good[k + 1 :]:
            if l == m and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= 0.98:
                links[i] += 1
                links[j] += 1
                edges.append((i, j))
    got = {r["id"]: r for r in embedding_dedup.near_duplicate_embeddings(df).collect()}
    assert len(got) == len(rows)
    found = sum(r["n_links"] for r in got.values())
    assert all(r["n_links"] <= links[i] for i, r in got.items())
    assert found >= 0.99 * sum(links.values()) > 0  # the stated recall of random filters
    want = components([r[0] for r in rows], edges)
    assert np.mean([got[i]["component_id"] == want[i] for i in want]) > 0.97
    assert embedding_dedup.near_duplicate_embeddings(df.limit(0)).count() == 0


def test_filters_are_all_directions_over_the_height():
    rng = np.random.default_rng(14)
    unit = rng.standard_normal((40, 12))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for blocks in (2, 3):
        caps = embedding_dedup.Filters(12, blocks, 20)
        got = caps.decode(unit)
        for v, found in zip(unit, got):
            want = []
            for repeat, words in enumerate(caps.codes):
                sums = np.zeros(1)
                for w in words:
                    sums = (sums[:, None] + (v @ w)[None, :]).ravel()
                assert not (np.abs(sums - caps.height) < 1e-6).any()
                want += (np.flatnonzero(sums >= caps.height) + repeat * len(sums)).tolist()
            assert found.tolist() == want
        assert 0.5 * embedding_dedup.FILTERS < np.mean([len(f) for f in got]) / embedding_dedup.REPEATS < 2 * embedding_dedup.FILTERS
    assert embedding_dedup.code_shape(10**9)[0] > 2 and np.prod(embedding_dedup.code_shape(10**7)) >= 1


def test_recall_of_filters_at_the_threshold():
    rng = np.random.default_rng(15)
    for vectors in (100, 1000, 20_000):
        caps = embedding_dedup.Filters(64, *embedding_dedup.code_shape(vectors))
        u = rng.standard_normal((300, 64))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        w = rng.standard_normal((300, 64))
        w -= (w * u).sum(axis=1, keepdims=True) * u
        w /= np.linalg.norm(w, axis=1, keepdims=True)
        pairs = zip(caps.decode(u), caps.decode(0.98 * u + np.sqrt(1 - 0.98**2) * w))
        assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in pairs]) > 0.97


def test_repeated_vector_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 1.0], 0), (None, [0.0, 1.0], 0)], "vec_id bigint, embedding array<double>, label int")
    rows = sorted((str(r["id"]), r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicate_embeddings(df).collect())
    assert rows == [("1", 1, 1, True), ("1", 1, 1, True), ("1", 1, 1, True), ("2", 1, 1, False), ("None", 0, None, True)]


def brute_top(rows, wanted, k=5):
    good = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    out = []
    for i, q in good:
        if wanted(i):
            best = sorted((-int(q @ c), j) for j, c in good if j != i and len(c) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k_is_that_of_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(10)
    rows = [(i, rng.standard_normal(16).round(1).tolist()) for i in range(900)] + [(900 + i, [1.0] * 16) for i in range(60)]
    rows += [(2000, None), (2001, []), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [0.5] * 3), (2005, [0.5] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<double>, score int, id int").repartition(5)
    for block in (8192, 128):
        monkeypatch.setattr(topk, "BLOCK", block)
        got = topk.top_k_search(df, df.where(F.col("vec_id") % 7 == 0))
        assert sorted(map(tuple, got.collect())) == brute_top(rows, lambda i: i % 7 == 0)
    assert topk.top_k_search(df.limit(0), df).count() == 0 and topk.top_k_search(df, df.limit(0)).count() == 0


def test_lists_are_read_no_further_than_the_bounds_need():
    rng = np.random.default_rng(16)
    vectors = rng.integers(-200, 200, (4000, 12))
    vectors[:5] = 2000  # no outsider can reach these
    lists = topk.Lists(np.arange(4000), vectors)
    query = np.full(12, 300)
    best = lists.top(query, -1, 5)
    assert best == [(12 * 2000 * 300, i) for i in range(5)] and 0 < lists.depth_read <= 4000 // topk.STEPS
    for q in rng.integers(-300, 300, (20, 12)):
        want = sorted(((int(v @ q), -i) for i, v in enumerate(vectors) if i != 7), reverse=True)[:5]
        for floor in (-np.inf, want[-1][0], want[0][0]):
            got = lists.top(q, 7, 5, floor)
            assert [g for g in got if g[0] >= floor] == [(s, -i) for s, i in want if s >= floor]


def test_a_repeated_candidate_takes_its_places(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.0])], "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in topk.top_k_search(df, df.where("vec_id = 1"), k=2).orderBy("rank").collect()]
    assert [g[2] for g in got] == [2, 2]


def best_shard(key, shards):
    return max(range(shards), key=lambda s: (hashlib.md5(f"{key}:{s}".encode()).hexdigest(), -s))


def test_shards_are_rendezvous(spark, documents, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sharding.shard_documents(df, 40).toPandas()
    assert len(rows) == len(documents)
    for key, shard, grown in zip(rows.doc_id, rows.shard, rows.grown_shard):
        assert shard == best_shard(key, 40) and grown == best_shard(key, 41) and grown in (shard, 40)
    for _, own in rows.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


def test_weighted_shards(spark):
    got = spark.range(6000).select(sharding.rendezvous_shard(F.col("id"), [1.0, 3.0]).alias("s")).groupBy("s").count().collect()
    share = {r["s"]: r["count"] / 6000 for r in got}
    assert abs(share[1] - 0.75) < 0.03
    with pytest.raises(ValueError):
        sharding.rendezvous_shard(F.col("id"), [1.0, 0.0])


def test_shard_edges(spark, edges, nothing):
    rows = sharding.shard_documents(edges, 3).toPandas()
    assert len(rows) == edges.count() and sharding.shard_documents(nothing, 3).count() == 0
    assert rows[rows.doc_id == 2]["size"].tolist() == [16] and rows[rows.doc_id == 2].text_crc32.tolist() == [0]
    for _, own in rows.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_matches_its_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, sf_dir).toPandas()[list(want.columns)]
    order = list(want.columns)
    pd.testing.assert_frame_equal(got.sort_values(order).reset_index(drop=True), want.sort_values(order).reset_index(drop=True), check_dtype=False)


def test_links_at_the_edge_of_the_similarity(spark):
    # each pair has similarity 0.8 and 25 or 26 of 64 symbols apart, and no third text between
    seeds = [1406, 1710, 9553, 15648, 17868, 20543, 29129]
    rows = []
    for i, seed in enumerate(seeds):
        words = [f"w{seed}x{j}" for j in range(9)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:8]))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["id"]: r["component_id"] for r in got} == {i: i // 2 * 2 for i in range(2 * len(seeds))}
