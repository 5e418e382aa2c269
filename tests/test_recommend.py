"""Affinity, top categories, profiles, cold start and recommendations."""

import datetime as dt

from pyspark.sql import functions as F

from vitrine.operators import embed, recommend

TS = dt.datetime(2024, 1, 1)


def make(spark):
    products = spark.createDataFrame(
        [(1, "red lamp", "Home", 10.0), (2, "blue lamp", "Home", 12.0), (3, "red ball", "Toys", 3.0),
         (4, "big ball", "Toys", 4.0), (5, "red book", "Books", 8.0), (6, "old book", "Books", None),
         (7, "red shoe", "Sports", 20.0)],
        "product_id long, title string, category string, price double")
    inter = spark.createDataFrame(
        # u1: Home 2, Toys 2, Books 1, Sports 1 (tie Home/Toys broken by name)
        [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (1, 7),
         # u2: only Books
         (2, 5), (2, 6),
         # u3: only orphan products
         (3, 99), (3, 98)],
        "user_id long, product_id long").withColumn("interaction_type", F.lit("view")) \
        .withColumn("ts", F.lit(TS).cast("timestamp_ntz"))
    return products, inter


def test_top_categories_ties_and_fewer_than_three(spark):
    products, inter = make(spark)
    aff = recommend.category_affinity(inter, products)
    top = {(r.user_id, r.rank): (r.category, r.n) for r in recommend.top_categories(aff).collect()}
    assert top == {(1, 1): ("Home", 2), (1, 2): ("Toys", 2), (1, 3): ("Books", 1),
                   (2, 1): ("Books", 2)}
    prof = {r.user_id: r.profile_text for r in
            recommend.user_profiles(recommend.top_categories(aff)).collect()}
    assert prof == {1: "Home Toys Books", 2: "Books"}


def test_affinity_sums_to_joined_rows(spark):
    products, inter = make(spark)
    aff = recommend.category_affinity(inter, products)
    assert aff.agg(F.sum("n")).first()[0] == recommend.interactions_enriched(inter, products).count()


def test_cold_start_covers_orphans_and_unknown(spark):
    products, inter = make(spark)
    aff = recommend.category_affinity(inter, products)
    users = spark.createDataFrame([(1,), (2,), (3,), (4,)], "user_id long")
    cold = sorted(r.user_id for r in recommend.cold_start_users(users, aff).collect())
    assert cold == [3, 4]
    assert recommend.orphan_interactions(inter, products).count() == 2


def test_recommend_all_equals_each_user_and_respects_categories(spark):
    products, inter = make(spark)
    cat = embed.product_vectors(products, None, image_dim=4)
    allrec = recommend.recommend_all(inter, cat, 3, image_dim=4)
    rows = allrec.collect()
    assert {r.user_id for r in rows} == {1, 2}
    allowed = {1: {"Home", "Toys", "Books"}, 2: {"Books"}}
    assert all(r.category in allowed[r.user_id] for r in rows)
    assert all(r.price is not None for r in rows)   # missing price becomes 0.0
    for uid in (1, 2):
        one = recommend.recommend_user(inter, cat, uid, 3, image_dim=4).collect()
        key = lambda r: (r.rank, r.product_id, r.distance)
        assert sorted(map(key, one)) == sorted(key(r) for r in rows if r.user_id == uid)
    assert recommend.recommend_user(inter, cat, 3, 3, image_dim=4).count() == 0
    # ranks are 1..k per user, scores follow the distance
    for r in rows:
        assert abs(r.score - 1 / (1 + r.distance)) < 1e-12 and abs(r.similarity - (1 - r.distance / 2)) < 1e-12


def test_search_text_skips_empty_queries_and_ranks(spark):
    products, _ = make(spark)
    cat = embed.product_vectors(products, None, image_dim=4)
    queries = spark.createDataFrame([("red lamp",), ("   ",), ("",), ("ball",)], "query_text string")
    res = recommend.search_text(cat, queries, 2, image_dim=4).collect()
    got = {}
    for r in sorted(res, key=lambda r: (r.query_text, r.rank)):
        got.setdefault(r.query_text, []).append(r.product_id)
    assert set(got) == {"red lamp", "ball"}
    assert got["red lamp"][0] == 1
    assert set(got["ball"]) == {3, 4}


def test_images_join_and_zero_fill(spark):
    products, _ = make(spark)
    images = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [1.0, 2.0])],
                                   "product_id long, image_vec array<float>")
    v = {r.product_id: r.image_vec for r in embed.product_vectors(products, images, 4).collect()}
    assert v[1] == [1.0, 0.0, 0.0, 0.0]
    assert v[2] == [0.0] * 4          # wrong size -> zeros
    assert v[3] == [0.0] * 4          # no image -> zeros


def test_recommend_all_same_on_blocked_path(spark):
    """Many profiles (beyond the broadcast check) take the blocked path; the
    answer is the same."""
    from vitrine.plans import registry
    from vitrine.sources import tables
    sf = "/root/testdata/sf0.001"
    cat, dim = registry.catalog_vectors(spark, sf, reuse=True)
    inter = tables.interactions(spark, sf)
    key = lambda r: (r.user_id, r.rank, r.product_id, r.distance)
    a = sorted(map(key, recommend.recommend_all(inter, cat, 5, image_dim=dim).collect()))
    b = sorted(map(key, recommend.recommend_all(inter, cat, 5, image_dim=dim, strategy="blocked",
                                                block_rows=7, query_block_rows=5).collect()))
    assert a == b and len(a) > 0


def test_scratch_goes_with_its_block(spark):
    import os
    from vitrine.session import local_path, scratch, shared_dir
    folder = local_path(shared_dir(spark))
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    from vitrine.plans import registry
    with scratch(spark):
        assert registry.QUERIES["recommend_user"](spark, "/root/testdata/sf0.001").count() > 0
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before
