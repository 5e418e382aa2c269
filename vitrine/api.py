"""The reference's three endpoints as DataFrame functions.

``search_products`` (text search with ``top_k``), ``get_product`` (lookup by
id) and ``get_user_recommendations`` (a user's top categories, then filtered
k-NN) answer one request each, through the same batched operators that
serve a stream of requests (``streaming.requests``); nothing here is a new
operator. ``catalog`` is a table with a ``vector`` column, e.g. the written
vector collection of the build or ``embed.product_vectors``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import TEXT_DIM
from vitrine.operators.recommend import DEFAULT_K
from vitrine.streaming.requests import (RECOMMEND_REQUEST, SEARCH_REQUEST, answer_recommendations,
                                        answer_searches)


def _image_dim(catalog: DataFrame, image_dim: int | None) -> int:
    if image_dim is not None:
        return image_dim
    row = catalog.select(F.size("vector").alias("n")).first()
    return int(row["n"]) - TEXT_DIM if row else 0


def search_products(catalog: DataFrame, query: str, top_k: int = DEFAULT_K,
                    image_dim: int | None = None) -> DataFrame:
    """Rows (rank, product_id, title, category, price, score) of one search."""
    spark = catalog.sparkSession
    req = spark.createDataFrame([("search", query, top_k)], SEARCH_REQUEST)
    return answer_searches(req, catalog, _image_dim(catalog, image_dim)).drop("request_id")


def get_product(catalog: DataFrame, product_id) -> DataFrame:
    """The product's row, or no row when it is not in the catalogue."""
    return catalog.filter(F.col("product_id") == F.lit(product_id))


def get_products(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """Batch lookup: catalogue rows for the ``product_id`` values in ``ids``
    (an equi-join; unknown ids give no row)."""
    return catalog.join(ids.select("product_id").distinct(), "product_id", "inner")


def get_user_recommendations(interactions: DataFrame, catalog: DataFrame, user_id,
                             top_k: int = DEFAULT_K, image_dim: int | None = None) -> DataFrame:
    """Rows (user_id, profile_text, rank, product fields, score, message);
    a user without history gets one row with the "No history" message."""
    spark = catalog.sparkSession
    req = spark.createDataFrame([("user", str(user_id), top_k)], RECOMMEND_REQUEST)
    return answer_recommendations(req, interactions, catalog,
                                  _image_dim(catalog, image_dim)).drop("request_id")


def analytics_page(catalog: DataFrame, log: DataFrame) -> dict[str, DataFrame]:
    """The analytics page's numbers: key metrics, products per category,
    price histogram, interaction types with shares, the ten latest events."""
    from vitrine.operators import analytics
    return {
        "metrics": analytics.catalog_metrics(catalog, log),
        "formatted": analytics.formatted_metrics(catalog, log),
        "category_counts": analytics.category_counts(catalog),
        "price_histogram": analytics.price_histogram(catalog),
        "interaction_types": analytics.interaction_type_share(log),
        "recent": analytics.recent_interactions(log),
    }


def system_status(spark, out) -> DataFrame:
    """The status page: rows, null keys, orphans and readiness of each table
    written by ``plans.build.build`` (``out`` is its ``BuildOutput``)."""
    from vitrine.plans.build import table_status
    return table_status(spark, out)
