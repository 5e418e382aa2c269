"""Exact and approximate k-NN against a brute-force reference."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import knn
from vitrine.sources import tables

SF = "/root/testdata/sf0.001"


def brute(ids, mat, qids, qmat, k, allowed=None, groups=None):
    """Plain numpy: all distances, rounded, sorted by (distance, id)."""
    out = {}
    xn = np.linalg.norm(mat, axis=1)
    for qi, q in zip(qids, qmat):
        qn = np.linalg.norm(q)
        cand = []
        for j, x in zip(ids, range(len(ids))):
            if qn == 0 or xn[x] == 0:
                continue
            if allowed is not None and groups[x] not in allowed[qi]:
                continue
            d = 1 - float(q @ mat[x]) / (qn * xn[x])
            cand.append((np.floor(max(d, 0.0) * 1e6 + 0.5) / 1e6, j))
        cand.sort()
        out[qi] = cand[:k]
    return out


def as_dict(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.distance, r.item_id))
    return out


@pytest.fixture(scope="module")
def vec(spark):
    return tables.vectors(spark, SF).cache()


@pytest.fixture(scope="module")
def vec_np(vec):
    rows = vec.orderBy("vec_id").collect()
    ids = [r.vec_id for r in rows]
    mat = np.array([r.embedding for r in rows], dtype=np.float64)
    labels = [r.label for r in rows]
    return ids, mat, labels


@pytest.mark.parametrize("strategy,block,qblock", [("broadcast", None, None),
                                                   ("blocked", 40, 17)])
def test_exact_matches_brute_force(vec, vec_np, strategy, block, qblock):
    ids, mat, _ = vec_np
    opts = {"strategy": strategy}
    if block:
        opts.update(block_rows=block, query_block_rows=qblock)
    got = as_dict(knn.similarity_topk(vec, vec, 7, item_id="vec_id", item_vec="embedding",
                                      query_id="vec_id", query_vec="embedding", **opts))
    want = brute(ids, mat, ids, mat, 7)
    assert got == want


@pytest.mark.parametrize("strategy", ["broadcast", "blocked"])
def test_filtered_matches_brute_force(vec, vec_np, strategy):
    ids, mat, labels = vec_np
    q = vec.withColumn("allowed", F.array("label", (F.col("label") + 3) % 10))
    got = as_dict(knn.similarity_topk(vec, q, 4, item_id="vec_id", item_vec="embedding",
                                      item_group="label", query_id="vec_id", query_vec="embedding",
                                      query_allowed="allowed", strategy=strategy,
                                      block_rows=30, query_block_rows=11))
    allowed = {i: {lab, (lab + 3) % 10} for i, lab in zip(ids, labels)}
    by_id = dict(zip(ids, labels))
    want = brute(ids, mat, ids, mat, 4, allowed, [by_id[i] for i in ids])
    assert got == want
    for qid, hits in got.items():
        assert all(by_id[item] in allowed[qid] for _, item in hits)


def test_zero_null_vectors_and_ties(spark):
    items = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [0.0, 1.0])],
        "item_id long, item_vec array<float>")
    queries = spark.createDataFrame([("a", [3.0, 0.0]), ("z", [0.0, 0.0])],
                                    "query_id string, query_vec array<float>")
    for strategy in ("broadcast", "blocked"):
        got = as_dict(knn.similarity_topk(items, queries, 4, strategy=strategy))
        # equal distances break by item id; zero and null vectors never rank
        assert got == {"a": [(0.0, 1), (0.0, 2), (0.0, 3), (1.0, 6)]}, strategy


def test_topk_is_prefix_of_full_order(vec):
    full = as_dict(knn.similarity_topk(vec, vec, 20, item_id="vec_id", item_vec="embedding",
                                       query_id="vec_id", query_vec="embedding"))
    top = as_dict(knn.similarity_topk(vec, vec, 5, item_id="vec_id", item_vec="embedding",
                                      query_id="vec_id", query_vec="embedding"))
    assert all(top[q] == full[q][:5] for q in top)


def test_same_result_for_any_partitioning(spark, vec):
    res = []
    for n in (1, 4, 50):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        res.append(as_dict(knn.similarity_topk(vec.repartition(n), vec, 3, item_id="vec_id",
                                               item_vec="embedding", query_id="vec_id",
                                               query_vec="embedding", strategy="blocked",
                                               block_rows=64, query_block_rows=64)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert res[0] == res[1] == res[2]


def test_hot_group_is_split_into_blocks(spark):
    """A group holding most rows is cut into several blocks, so no task gets
    the whole group."""
    rows = [(i, [float(i % 7 + 1), float(i % 5)], "hot" if i < 900 else f"g{i}") for i in range(1000)]
    items = spark.createDataFrame(rows, "item_id long, item_vec array<float>, grp string")
    queries = spark.createDataFrame([(f"q{i}", [1.0, float(i)], ["hot"]) for i in range(30)],
                                    "query_id string, query_vec array<float>, allowed array<string>")
    # 900 hot items at 100 per block -> 9 item blocks; 30 queries at 10 per
    # block -> 3 query blocks: 27 cogroups of at most ~2x the block size
    per_block = (items.filter("grp = 'hot'").withColumn("ib", F.pmod(F.xxhash64("item_id"), F.lit(9)))
                 .groupBy("ib").count().collect())
    assert len(per_block) == 9 and max(r["count"] for r in per_block) < 200
    hits = knn._blocked_path(items.select("item_id", "item_vec", F.col("grp").alias("group")),
                             queries.select("query_id", "query_vec", "allowed"), 3, True, 100, 10)
    # each (item block, query block) task returns at most k hits per query
    per_query = hits.filter("query_id = 'q0'").count()
    assert per_query <= 9 * 3
    got = as_dict(knn.similarity_topk(items, queries, 3, item_group="grp", query_allowed="allowed",
                                      strategy="blocked", block_rows=100, query_block_rows=10))
    want = as_dict(knn.similarity_topk(items, queries, 3, item_group="grp", query_allowed="allowed",
                                       strategy="broadcast"))
    assert got == want


def test_lsh_recall_floor(vec):
    exact = knn.similarity_topk(vec, vec, 5, item_id="vec_id", item_vec="embedding",
                                query_id="vec_id", query_vec="embedding")
    approx = knn.lsh_topk(vec, vec, 5, dim=64, item_id="vec_id", item_vec="embedding",
                          query_id="vec_id", query_vec="embedding")
    e = set(map(tuple, exact.select("query_id", "item_id").collect()))
    a = set(map(tuple, approx.select("query_id", "item_id").collect()))
    assert len(e & a) / len(e) >= 0.7
    # every approximate hit is a true distance
    ad = {(r.query_id, r.item_id): r.distance for r in approx.collect()}
    ed = {(r.query_id, r.item_id): r.distance for r in exact.collect()}
    assert all(ad[p] == ed[p] for p in e & a)


def test_registered_lsh_recall_without_own_row(spark, vec):
    """At the registered tables and bits, and at the defaults: 0.9 of the exact neighbours other than the row itself."""
    from vitrine.plans import registry as R
    ids = dict(item_id="vec_id", item_vec="embedding", query_id="vec_id", query_vec="embedding")

    def pairs(hits):
        return set(map(tuple, hits.filter("query_id <> item_id").select("query_id", "item_id").collect()))

    def recall(exact, approx):
        return len(exact & approx) / len(exact)

    exact = pairs(knn.similarity_topk(vec, vec, R.LSH_K + 1, **ids))
    registered = dict(n_tables=R.LSH_TABLES, n_bits=R.LSH_BITS, seed=R.LSH_SEED)
    assert recall(exact, pairs(knn.lsh_topk(vec, vec, R.LSH_K + 1, dim=64, **registered, **ids))) >= 0.9
    assert recall(exact, pairs(knn.lsh_topk(vec, vec, R.LSH_K + 1, dim=64, **ids))) >= 0.9
    sf = os.environ.get("VITRINE_ORACLE_SF", "/root/testdata/sf0.001")
    assert recall(pairs(R.knn_batch(spark, sf)), pairs(R.knn_lsh(spark, sf))) >= 0.9


def test_broadcast_path_does_not_shuffle_items(vec):
    hits = knn.similarity_topk(vec, vec, 3, item_id="vec_id", item_vec="embedding",
                               query_id="vec_id", query_vec="embedding", strategy="broadcast")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan or "PythonMapInArrow" in plan
    assert plan.count("Exchange") <= 1   # only the final per-query rank


def test_repeated_allowed_groups_do_not_repeat_hits(spark):
    items = spark.createDataFrame([(i, [1.0, float(i)], "a" if i % 2 else "b") for i in range(10)],
                                  "item_id long, item_vec array<float>, grp string")
    queries = spark.createDataFrame([("q", [1.0, 2.0], ["a", "a", "b", "a"])],
                                    "query_id string, query_vec array<float>, allowed array<string>")
    for strategy in ("broadcast", "blocked"):
        got = as_dict(knn.similarity_topk(items, queries, 5, item_group="grp", query_allowed="allowed",
                                          strategy=strategy, block_rows=3, query_block_rows=1))
        ids = [i for _, i in got["q"]]
        assert len(ids) == 5 and len(set(ids)) == 5, (strategy, got)


def test_null_groups_match_nothing_on_both_paths(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [1.0, 0.1], "a"), (3, [1.0, 0.2], None)],
                                  "item_id long, item_vec array<float>, grp string")
    queries = spark.createDataFrame([("q", [1.0, 0.0], ["a", None]), ("r", [1.0, 0.0], None)],
                                    "query_id string, query_vec array<float>, allowed array<string>")
    for strategy in ("broadcast", "blocked"):
        got = as_dict(knn.similarity_topk(items, queries, 3, item_group="grp", query_allowed="allowed",
                                          strategy=strategy))
        assert {q: [i for _, i in h] for q, h in got.items()} == {"q": [2]}, strategy


def test_round6_matches_sql_round_half_away():
    import duckdb
    vals = np.array([0.0, 0.1234565, 0.0000005, 1.9999995, 0.333333333, 1.0, 0.7067355, 2.0])
    got = knn._round6(vals)
    con = duckdb.connect()
    want = [con.execute("select round(?::double, 6)", [float(v)]).fetchone()[0] for v in vals]
    assert [float.hex(float(g)) for g in got] == [float.hex(w) for w in want]


def test_faulty_vectors_are_left_out_by_every_path(spark):
    nan = float("nan")
    items = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [0.0, 0.0]), (5, [1.0]), (6, None), (7, [0.0, 1.0]),
         (8, [float("inf"), 0.0])], "item_id long, item_vec array<double>")
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("bad", [nan, 0.0])], "query_id string, query_vec array<double>")
    want = {"q": [(0.0, 1), (1.0, 7)]}
    for strategy in ("broadcast", "blocked"):
        assert as_dict(knn.similarity_topk(items, queries, 5, strategy=strategy, dim=2)) == want, strategy
    lsh = knn.lsh_topk(items, queries, 5, dim=2, n_tables=30, n_bits=1)
    assert as_dict(lsh) == want


def test_lsh_candidates_fall_as_bits_grow(spark, vec):
    """Pairs that share a bucket in one table, by number of bits."""
    n = vec.count()
    shares = []
    for bits in (2, 4, 8):
        planes = knn.hyperplanes(64, 1, bits, 7)
        sizes = (knn.with_lsh_buckets(vec.select("vec_id", "embedding"), "embedding", planes)
                 .groupBy(F.col("buckets")[0].alias("b")).count().collect())
        shares.append(sum(r["count"] ** 2 for r in sizes) / n ** 2)
    assert shares[0] > 2 * shares[1] > 4 * shares[2]


def test_small_blocks_grow_with_the_table(spark, vec, vec_np):
    """Blocks of one row would send every item to every query: there are MOST_BLOCKS pairs of blocks at most."""
    ids, mat, _ = vec_np
    items = vec.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("item_vec")).filter(knn.rankable("item_vec"))
    queries = items.filter("item_id % 5 = 0").select(F.col("item_id").alias("query_id"), F.col("item_vec").alias("query_vec"))
    n = knn._blocked_path(items, queries, 1, False, 1, 1).groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert len(ids) > knn.MOST_BLOCKS >= n
    hits = knn.similarity_topk(items, queries, 4, block_rows=1, query_block_rows=1)
    qids = [i for i in ids if i % 5 == 0]
    assert as_dict(hits) == brute(ids, mat, qids, [mat[ids.index(i)] for i in qids], 4)
    sizes = [(2_000, 20), (120_000, 1_200), (720_000, 7_200), (12_000_000, 120_000), (0, 5), (5, 0)]
    rows = spark.createDataFrame(sizes, "n long, q long")
    got = rows.select(*knn._block_counts(F.col("n"), F.col("q"), 250, 3)).collect()
    assert [tuple(r) for r in got] == [(8, 7), (64, 1), (64, 1), (600, 6), (0, 2), (1, 0)]


def test_lsh_equals_a_join_of_buckets_without_one(spark):
    """Repeated ids, repeated rows and null ids; no join of candidates in the plan."""
    rng = np.random.default_rng(3)
    data = [(int(i) % 90, [float(x) for x in rng.standard_normal(8)]) for i in range(120)]
    data += data[:20] + [(None, data[0][1]), (200, None), (201, [0.0] * 8)]
    items = spark.createDataFrame(data, "item_id long, item_vec array<float>")
    queries = items.filter("item_id IS NULL OR item_id % 10 = 0").toDF("query_id", "query_vec")
    approx = knn.lsh_topk(items, queries, 6, dim=8, n_tables=3, n_bits=3, seed=5)
    planes = knn.hyperplanes(8, 3, 3, 5)
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in data if i is not None and v is not None and any(v)]
    buckets = {}
    for i, v in rows:
        for t in range(3):
            buckets.setdefault(i, set()).add((t, tuple(planes[t] @ v >= 0)))
    want = {}
    for q, a in rows:
        if q % 10 == 0:
            want.setdefault(q, []).extend(
                (float(knn._round6(np.array([max(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), 0.0)]))[0]), i)
                for i, b in rows if buckets[q] & buckets[i])
    assert as_dict(approx) == {q: sorted(hits)[:6] for q, hits in want.items()}
    assert "Join" not in approx._jdf.queryExecution().optimizedPlan().toString()
    names = spark.createDataFrame([(f"n{i}", v) for i, v in data[:90]], "item_id string, item_vec array<float>")
    named = knn.lsh_topk(names, names.toDF("query_id", "query_vec"), 2, dim=8)
    assert named.filter("rank = 1 AND query_id = item_id AND distance = 0").count() == 90
