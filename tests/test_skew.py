"""A key holding a third of all rows: results stay whole and the hot
partition is split (AQE skew join) instead of landing in one task."""

import datetime as dt

from pyspark.sql import functions as F

from vitrine.operators import clean, recommend

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",          # force a sort-merge join
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


def with_conf(spark, conf, fn):
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return fn()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_hot_product_join_is_split_and_whole(spark):
    n = 30000
    hot = 7
    inter = (spark.range(n)
             .select((F.col("id") % 500).alias("user_id"),
                     F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.col("id") % 1000).alias("product_id"))
             .withColumn("interaction_type", F.lit("view"))
             .withColumn("ts", F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")))
    products = spark.range(1000).select(F.col("id").alias("product_id"),
                                        (F.col("id") % 6).cast("string").alias("category"),
                                        F.lit("t").alias("title"), F.lit(1.0).alias("price"))

    def run():
        df = recommend.interactions_enriched(inter, products)
        total = df.count()
        df.collect()
        return total, df._jdf.queryExecution().executedPlan().toString()

    total, plan = with_conf(spark, SKEW_CONF, run)
    assert total == n                      # nothing dropped or capped
    assert "SortMergeJoin(skew=true)" in plan and "AQEShuffleRead skewed" in plan


def test_hot_title_dedup_combines_map_side(spark):
    """A title shared by a third of the rows: partial aggregation leaves at
    most one row per map task for it before the shuffle."""
    n = 30000
    raw = spark.range(n).select(
        F.col("id").cast("string").alias("product_id"),
        F.when(F.col("id") % 3 == 0, F.lit("Hot Lamp")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("title"),
        F.lit(None).cast("string").alias("description"), F.lit("Home").alias("category"),
        F.lit(None).cast("string").alias("brand"), F.lit("9.5").alias("price"),
        F.lit(None).cast("string").alias("rating"), F.lit(None).cast("string").alias("num_reviews"))
    out = clean.clean_products(raw.repartition(8))
    rows = out.filter(F.col("title") == "Hot Lamp").collect()
    assert len(rows) == 1 and rows[0].product_id == "0"
    assert out.count() == n - (n // 3 - 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan
