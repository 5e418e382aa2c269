"""The endpoint functions answer like the batch operators."""

from vitrine import api
from vitrine.operators import recommend
from vitrine.plans import registry
from vitrine.sources import tables
from vitrine.streaming.requests import NO_HISTORY

SF = "/root/testdata/sf0.001"


def test_endpoints(spark):
    catalog, dim = registry.catalog_vectors(spark, SF, reuse=True)
    inter = tables.interactions(spark, SF)
    name = sorted(r.title for r in catalog.select("title").collect())[0]
    got = [(r.rank, r.product_id) for r in api.search_products(catalog, name, 4).orderBy("rank").collect()]
    want = [(r.rank, r.product_id) for r in recommend.search_text(
        catalog, spark.createDataFrame([(name,)], "query_text string"), 4, image_dim=dim).orderBy("rank").collect()]
    assert got == want and len(got) == 4
    pid = got[0][1]
    assert api.get_product(catalog, pid).count() == 1
    assert api.get_product(catalog, "P-1").count() == 0
    ids = spark.createDataFrame([(pid,), (pid,), ("P-1",)], "product_id string")
    assert [r.product_id for r in api.get_products(catalog, ids).collect()] == [pid]
    user = registry.RECOMMEND_USER_ID
    recs = api.get_user_recommendations(inter, catalog, user, 3).collect()
    assert len(recs) == 3 and all(r.message is None for r in recs)
    cats = set(recs[0].profile_text.split(" "))
    assert all(r.category in cats for r in recs)
    cold = api.get_user_recommendations(inter, catalog, "U999999999").collect()
    assert len(cold) == 1 and cold[0].message == NO_HISTORY


def test_analytics_and_status_pages(spark):
    from vitrine.plans import build as build_plan
    catalog = registry.catalog(spark, SF)
    log = tables.event_log(spark, SF)
    page = api.analytics_page(catalog, log)
    assert set(page) == {"metrics", "formatted", "category_counts", "price_histogram",
                         "interaction_types", "recent"}
    assert page["recent"].count() == 10 and page["metrics"].count() == 1
    out, _ = build_plan.build(spark, tables.raw_products(spark, SF), tables.interactions(spark, SF),
                              tables.image_vectors(spark, SF), registry.image_dim(spark, SF))
    status = {r.table: r.ready for r in api.system_status(spark, out).collect()}
    assert status == {"products": True, "vectors": True, "interactions": True, "users": True}
