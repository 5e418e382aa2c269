"""Search and recommendation requests answered over a file stream."""

import json
import os
import tempfile

from vitrine.operators import recommend
from vitrine.plans import registry
from vitrine.sources import tables
from vitrine.streaming.requests import NO_HISTORY, serve_recommendations, serve_searches

SF = "/root/testdata/sf0.001"


def write_requests(folder, name, rows):
    with open(os.path.join(folder, name), "w") as fh:
        for r in rows:
            fh.write(json.dumps(r) + "\n")


def test_search_requests_match_batch_search(spark):
    catalog, dim = registry.catalog_vectors(spark, SF, reuse=True)
    names = sorted(r.p_name for r in tables.read_table(spark, SF, "part").select("p_name").distinct().collect())[:3]
    folder, out = tempfile.mkdtemp(prefix="vitrine-req-"), tempfile.mkdtemp(prefix="vitrine-ans-")
    write_requests(folder, "a.json", [{"request_id": "r1", "query": names[0], "top_k": 3},
                                      {"request_id": "r2", "query": names[1]},
                                      {"request_id": "r3", "query": "   ", "top_k": 5}])
    write_requests(folder, "b.json", [{"request_id": "r4", "query": names[0], "top_k": 1},
                                      {"request_id": "r5", "query": names[2], "top_k": 20}])
    serve_searches(spark, folder, catalog, dim, out, checkpoint=tempfile.mkdtemp(),
                   available_now=True).awaitTermination(300)
    got = {}
    for r in spark.read.parquet(out).collect():
        got.setdefault(r.request_id, []).append((r.rank, r.product_id, r.score))
    want_k = {"r1": (names[0], 3), "r2": (names[1], 10), "r4": (names[0], 1), "r5": (names[2], 20)}
    batch = recommend.search_text(catalog, spark.createDataFrame([(n,) for n in names], "query_text string"),
                                  20, image_dim=dim).collect()
    for rid, (q, k) in want_k.items():
        want = sorted((r.rank, r.product_id, r.score) for r in batch if r.query_text == q and r.rank <= k)
        assert sorted(got[rid]) == want, rid
    assert "r3" not in got   # an empty query has no answer


def test_recommendation_requests_match_batch(spark):
    catalog, dim = registry.catalog_vectors(spark, SF, reuse=True)
    inter = tables.interactions(spark, SF)
    folder, out = tempfile.mkdtemp(prefix="vitrine-req-"), tempfile.mkdtemp(prefix="vitrine-ans-")
    user = registry.RECOMMEND_USER_ID
    write_requests(folder, "a.json", [{"request_id": "u1", "user_id": user, "top_k": 4},
                                      {"request_id": "u2", "user_id": "U999999999"}])
    serve_recommendations(spark, folder, inter, catalog, dim, out, checkpoint=tempfile.mkdtemp(),
                          available_now=True).awaitTermination(300)
    rows = spark.read.parquet(out).collect()
    got = sorted((r.rank, r.product_id) for r in rows if r.request_id == "u1")
    want = sorted((r.rank, r.product_id) for r in
                  recommend.recommend_user(inter, catalog, user, 4, image_dim=dim).collect())
    assert got == want and len(got) == 4
    cold = [r for r in rows if r.request_id == "u2"]
    assert len(cold) == 1 and cold[0].product_id is None and cold[0].message == NO_HISTORY
