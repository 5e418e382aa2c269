"""Analytics metrics on inline rows, and the streaming form of the counts."""

import datetime as dt

from pyspark.sql import functions as F

from vitrine.operators import analytics
from vitrine.sources import tables, versions
from vitrine.streaming.activity import start_type_counts

SF = "/root/testdata/sf0.001"


def test_histogram_equal_prices_one_bin(spark):
    df = spark.createDataFrame([(7.5,), (7.5,), (7.5,)], "price double")
    rows = analytics.price_histogram(df).collect()
    assert len(rows) == 31
    assert [(r.bin, r.bin_lo, r.bin_hi, r["count"]) for r in rows if r["count"]] == [(0, 7.5, 7.5, 3)]


def test_histogram_ignores_null_and_nan_and_puts_max_last(spark):
    df = spark.createDataFrame([(0.0,), (None,), (float("nan"),), (30.0,), (15.0,), (29.999,)],
                               "price double")
    found = {r.bin: r["count"] for r in analytics.price_histogram(df).collect()}
    assert found.pop(None) == 2      # null and NaN
    assert set(found) == set(range(30))
    assert {b: c for b, c in found.items() if c} == {0: 1, 15: 1, 29: 2}


def test_histogram_skips_infinite_prices(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (2.0,), (float("-inf"),)], "price double")
    rows = analytics.price_histogram(df).collect()
    assert [r["count"] for r in rows if r.bin is None] == [2]      # both infinities
    rows = sorted((r.bin, r["count"], r.bin_lo, r.bin_hi) for r in rows if r.bin is not None and r["count"])
    assert rows == [(0, 1, 1.0, round(1 + 1 / 30, 6)), (29, 1, round(1 + 29 / 30, 6), 2.0)]


def test_histogram_counts_sum_to_non_null_prices(spark):
    from vitrine.plans.registry import catalog
    prods = catalog(spark, SF)
    total = sum(r["count"] for r in analytics.price_histogram(prods).collect())
    assert total == prods.filter(F.col("price").isNotNull()).count()


def test_counts_shares_and_formats(spark):
    rows = [(i, 1, t, dt.datetime(2024, 1, 1, 0, 0, i)) for i, t in
            enumerate(["view"] * 5 + ["click"] * 3 + ["purchase"] * 2 + [None])]
    log = spark.createDataFrame(rows, "event_id long, user_id long, interaction_type string, ts timestamp_ntz")
    counts = [(r.interaction_type, r["count"]) for r in analytics.interaction_type_counts(log).collect()]
    assert counts == [("view", 5), ("click", 3), ("purchase", 2)]
    share = {r.interaction_type: r.share for r in analytics.interaction_type_share(log).collect()}
    assert share == {"view": 0.5, "click": 0.3, "purchase": 0.2}
    prods = spark.createDataFrame([(1.005,), (2.0,)], "price double")
    fm = {r.interaction_type: (r.share_text, r.avg_price_text)
          for r in analytics.formatted_metrics(prods, log).collect()}
    assert fm["view"] == ("50.0%", "$1.50")
    recent = [r.event_id for r in analytics.recent_interactions(log, 3).collect()]
    assert recent == [10, 9, 8]


def test_catalog_metrics_one_row(spark):
    prods = spark.createDataFrame([("A", 2.0), ("B", 4.0), (None, None)], "category string, price double")
    log = spark.range(7)
    r = analytics.catalog_metrics(prods, log).first()
    assert (r.n_products, r.n_categories, r.avg_price, r.n_interactions) == (3, 2, 3.0, 7)


def test_stream_counts_equal_batch_counts(spark):
    q = start_type_counts(spark, SF, "vitrine_type_counts_test")
    q.awaitTermination(300)
    got = {r.interaction_type: r["count"] for r in spark.table("vitrine_type_counts_test").collect()}
    want = {r.interaction_type: r["count"]
            for r in analytics.interaction_type_counts(tables.event_log(spark, SF)).collect()}
    assert got == want and sum(got.values()) == 1000


def test_stream_resumes_from_checkpoint(spark):
    """A restarted query picks up only new files and keeps its running counts."""
    import shutil
    import tempfile
    folder = tempfile.mkdtemp(prefix="vitrine-stream-in-")
    ckpt = tempfile.mkdtemp(prefix="vitrine-stream-ckpt-")
    shutil.copy(f"{SF}/events.parquet", f"{folder}/events-1.parquet")
    q = start_type_counts(spark, folder, "vitrine_resume_test", checkpoint=ckpt)
    q.awaitTermination(300)
    first = {r.interaction_type: r["count"] for r in spark.table("vitrine_resume_test").collect()}
    shutil.copy(f"{SF}/events.parquet", f"{folder}/events-2.parquet")
    q = start_type_counts(spark, folder, "vitrine_resume_test", checkpoint=ckpt)
    q.awaitTermination(300)
    second = {r.interaction_type: r["count"] for r in spark.table("vitrine_resume_test").collect()}
    assert second == {t: 2 * n for t, n in first.items()}


def test_stream_counts_to_a_durable_table(spark):
    import tempfile
    out = tempfile.mkdtemp(prefix="vitrine-counts-") + "/counts"
    start_type_counts(spark, SF, out=out, checkpoint=tempfile.mkdtemp()).awaitTermination(300)
    got = {r.interaction_type: r["count"] for r in versions.read_table(spark, out).collect()}
    want = {r.interaction_type: r["count"]
            for r in analytics.interaction_type_counts(tables.event_log(spark, SF)).collect()}
    assert got == want
