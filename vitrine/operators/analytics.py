"""Catalogue and interaction statistics of the analytics page.

Every metric reads a pruned scan (only the columns it needs); aggregates
combine partially before each shuffle, and the recent-rows list is a top-n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.formatting import money, percent

HISTOGRAM_BINS = 30  # fixed value: bins of the price histogram


def value_counts(df: DataFrame, col: str, count_name: str = "count") -> DataFrame:
    """Non-null values of ``col`` with their row counts, most frequent first
    (ties by value)."""
    return (df.filter(F.col(col).isNotNull())
              .groupBy(col).agg(F.count(F.lit(1)).alias(count_name))
              .orderBy(F.col(count_name).desc(), F.col(col).asc()))


def category_counts(products: DataFrame) -> DataFrame:
    """Products per category: (category, count)."""
    return value_counts(products, "category", "count")


def interaction_type_counts(log: DataFrame) -> DataFrame:
    """Interactions per type: (interaction_type, count)."""
    return value_counts(log, "interaction_type", "count")


def interaction_type_share(log: DataFrame) -> DataFrame:
    """Share of all interactions per type (the pie chart)."""
    typed = log.filter(F.col("interaction_type").isNotNull())
    counts = typed.groupBy("interaction_type").agg(F.count(F.lit(1)).alias("count"))
    # The total is a scalar subquery over the per-type counts: it reuses the
    # counts' shuffle (one scan of the log) and needs neither a join nor a
    # single-partition window.
    total = counts.select(F.sum("count")).scalar()
    return counts.withColumn("share", F.round(F.col("count") / total, 6))


def catalog_metrics(products: DataFrame, interactions: DataFrame) -> DataFrame:
    """One row: total products, distinct categories, mean price, total
    interactions. Two independent aggregates, combined as scalar subqueries."""
    n_interactions = interactions.select(F.count(F.lit(1))).scalar()
    return products.agg(
        F.count(F.lit(1)).alias("n_products"),
        F.count_distinct("category").alias("n_categories"),
        F.round(F.avg("price"), 6).alias("avg_price"),
    ).withColumn("n_interactions", n_interactions)


def formatted_metrics(products: DataFrame, log: DataFrame) -> DataFrame:
    """Display strings: mean price as money and each type's share as percent."""
    avg_price = products.select(F.avg("price")).scalar()
    share = interaction_type_share(log)
    return share.select(
        "interaction_type",
        percent(F.col("share")).alias("share_text"),
        money(avg_price).alias("avg_price_text"),
    )


def price_histogram(products: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width histogram of prices between min and max.

    Rows: bin (0-based), bin_lo, bin_hi, count: every bin, empty ones too, over
    the finite prices, and one row with a null bin that counts the rows no bin
    can hold (null, NaN and infinite prices). The value ``max`` falls in the
    last bin; when all prices are equal they are in bin 0, of width 0. Min and
    max come from one scalar subquery (one extra scan, reused), not a join.
    """
    # only finite prices can be placed in equal-width bins
    prices = products.select("price").filter(
        F.col("price").isNotNull() & ~F.isnan("price")
        & (F.abs(F.col("price")) != F.lit(float("inf"))))
    bounds = prices.select(F.struct(F.min("price").alias("lo"), F.max("price").alias("hi"))).scalar()
    lo, hi = bounds.getField("lo"), bounds.getField("hi")
    width = (hi - lo) / F.lit(bins)
    b = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((F.col("price") - lo) / (hi - lo) * F.lit(bins)), F.lit(bins - 1))).cast("long")
    finite = F.col("price").isNotNull() & ~F.isnan("price") & (F.abs(F.col("price")) != F.lit(float("inf")))
    placed = products.select("price").withColumn("bin", F.when(finite, b))
    # Each empty bin enters as a row of weight 0, so one aggregate gives all of them.
    empty = (products.sparkSession.range(-1, bins)
             .select(F.lit(None).cast("double").alias("price"),
                     F.when(F.col("id") >= 0, F.col("id")).alias("bin"), F.lit(0).alias("weight")))
    return (placed.withColumn("weight", F.lit(1)).unionByName(empty)
            .groupBy("bin").agg(F.sum("weight").alias("count"))
            .select("bin",
                    F.round(lo + F.col("bin") * width, 6).alias("bin_lo"),
                    F.round(F.when(hi == lo, hi).otherwise(lo + (F.col("bin") + 1) * width), 6).alias("bin_hi"),
                    "count"))


def recent_interactions(log: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most recent rows (ties: higher event id first). Plans as a
    per-partition top-n followed by a merge of n rows per partition."""
    return log.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n)


def distinct_users(interactions: DataFrame) -> DataFrame:
    """The users table: distinct non-null user ids of the interaction log."""
    return interactions.select("user_id").filter(F.col("user_id").isNotNull()).distinct()
