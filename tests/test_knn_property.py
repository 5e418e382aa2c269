"""Property: both k-NN paths equal brute force on random data with ties."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vitrine.operators import knn


def brute(items, queries, k):
    out = {}
    for qid, qv, allowed in queries:
        qn = np.linalg.norm(qv)
        cand = []
        for iid, iv, grp in items:
            xn = np.linalg.norm(iv)
            if qn == 0 or xn == 0 or grp not in allowed:
                continue
            d = max(1 - float(np.dot(qv, iv)) / (qn * xn), 0.0)
            cand.append((knn._round6(np.array([d]))[0], iid))
        out[qid] = sorted(cand)[:k]
    return {q: v for q, v in out.items() if v}


vec = st.lists(st.integers(-2, 2), min_size=3, max_size=3)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(vec, st.sampled_from("abc")), min_size=1, max_size=25),
       st.lists(st.tuples(vec, st.lists(st.sampled_from("abcd"), min_size=1, max_size=3)),
                min_size=1, max_size=6),
       st.integers(1, 5))
def test_paths_equal_brute_force(spark, items, queries, k):
    it = [(i, np.array(v, dtype=float), g) for i, (v, g) in enumerate(items)]
    qs = [(f"q{j}", np.array(v, dtype=float), a) for j, (v, a) in enumerate(queries)]
    idf = spark.createDataFrame([(i, [float(x) for x in v], g) for i, v, g in it],
                                "item_id long, item_vec array<float>, grp string")
    qdf = spark.createDataFrame([(q, [float(x) for x in v], a) for q, v, a in qs],
                                "query_id string, query_vec array<float>, allowed array<string>")
    want = brute(it, qs, k)
    for strategy in ("broadcast", "blocked"):
        res = knn.similarity_topk(idf, qdf, k, item_group="grp", query_allowed="allowed",
                                  strategy=strategy, block_rows=4, query_block_rows=2).collect()
        got = {}
        for r in sorted(res, key=lambda r: (r.query_id, r.rank)):
            got.setdefault(r.query_id, []).append((r.distance, r.item_id))
        assert got == want, strategy
