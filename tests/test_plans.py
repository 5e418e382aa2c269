"""Physical-plan properties the scale design relies on."""

from vitrine.plans import registry

SF = "/root/testdata/sf0.001"


def executed(df):
    """Final adaptive plan (collect runs the DataFrame's own execution)."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_prunes_columns_and_limits_before_shuffle(spark):
    df = registry.QUERIES["user_top_categories"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
    # partial top-3 per user runs before the exchange on user_id
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "partial_count" in plan


def test_user_filter_reaches_the_scan(spark, tmp_path):
    """A user's filter is pushed to the scan of the written interactions table,
    which is clustered by user."""
    from pyspark.sql import functions as F
    from vitrine.plans import build
    from vitrine.schemas import INTERACTIONS
    from vitrine.sources import files, tables
    out, _ = build.build(spark, tables.raw_products(spark, SF), tables.interactions(spark, SF),
                         None, 4, out_root=str(tmp_path))
    mine = files.read_parquet(spark, out.interactions, INTERACTIONS).filter(
        F.col("user_id") == registry.RECOMMEND_USER_ID)
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(user_id,{registry.RECOMMEND_USER_ID})" in plan


def test_dedup_has_no_window_over_title_groups(spark):
    plan = registry.QUERIES["clean_products"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan
    assert "Window" not in plan


def test_share_total_reuses_the_counts_shuffle(spark):
    plan = executed(registry.QUERIES["interaction_type_share"](spark, SF))
    assert "ReusedExchange" in plan


def test_no_cross_join_anywhere(spark):
    for name in sorted(registry.QUERIES):
        plan = executed(registry.QUERIES[name](spark, SF))
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_recent_interactions_is_a_top_n(spark):
    plan = registry.QUERIES["recent_interactions"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
