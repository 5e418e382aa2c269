"""Search and recommendation: affinity, top categories, profiles, k-NN.

Recommending for every user at once never pairs users with products. Users
with the same ordered top-3 categories share one profile text, so the work
is: affinity -> top-3 per user -> distinct profiles -> one filtered k-NN per
profile -> join the k hits back to the users of each profile. With c
categories there are at most c + c(c-1) + c(c-1)(c-2) profiles, however
many users there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.vectors import score_halved, score_inverse
from vitrine.operators.embed import query_vectors
from vitrine.operators.knn import similarity_topk
from vitrine.session import materialize

TOP_CATEGORIES = 3  # fixed value: categories kept per user
DEFAULT_K = 10      # fixed value: default number of results


def interactions_enriched(interactions: DataFrame, products: DataFrame) -> DataFrame:
    """Interactions joined to their product (inner: orphans drop out)."""
    return interactions.join(products.select("product_id", "title", "category", "price"),
                             "product_id", "inner")


def category_affinity(interactions: DataFrame, products: DataFrame) -> DataFrame:
    """(user_id, category, n): interactions of each user per category.

    Interaction type does not weigh in. Partial counts are combined per
    map task before the shuffle on (user, category).
    """
    joined = interactions.select("user_id", "product_id").join(
        products.select("product_id", "category"), "product_id", "inner")
    return joined.groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("n"))


def top_categories(affinity: DataFrame, n: int = TOP_CATEGORIES) -> DataFrame:
    """(user_id, category, n, rank): a user's n most frequent categories,
    ties by category name. ``row_number() <= n`` lets Spark cut each user's
    list before the shuffle."""
    w = Window.partitionBy("user_id").orderBy(F.col("n").desc(), F.col("category").asc())
    return (affinity.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= n)
            .withColumn("rank", F.col("rank").cast("long")))


def user_profiles(top: DataFrame) -> DataFrame:
    """(user_id, categories, profile_text): categories in rank order joined
    by spaces. Each user has at most ``TOP_CATEGORIES`` rows, so the list is
    bounded."""
    ranked = top.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "category"))).alias("ranked"))
    cats = F.transform("ranked", lambda x: x["category"])
    return ranked.select("user_id", cats.alias("categories"),
                         F.array_join(cats, " ").alias("profile_text"))


def cold_start_users(users: DataFrame, affinity: DataFrame) -> DataFrame:
    """Users with no history that reaches a product (no affinity row)."""
    return users.select("user_id").distinct().join(
        affinity.select("user_id").distinct(), "user_id", "left_anti")


def orphan_interactions(interactions: DataFrame, products: DataFrame) -> DataFrame:
    """Interactions whose product is not in the catalogue."""
    return interactions.join(products.select("product_id"), "product_id", "left_anti")


def _results(hits: DataFrame, catalog: DataFrame) -> DataFrame:
    """k-NN hits -> result rows with defaults for missing fields."""
    return (hits.join(catalog.select("product_id", "title", "category", "price"),
                      hits.item_id == catalog.product_id, "inner")
            .select("query_id", "rank", "product_id",
                    F.coalesce("title", F.lit("")).alias("title"),
                    F.coalesce("category", F.lit("")).alias("category"),
                    F.coalesce("price", F.lit(0.0)).alias("price"),
                    F.col("distance"),
                    score_inverse(F.col("distance")).alias("score"),
                    score_halved(F.col("distance")).alias("similarity")))


def search_text(catalog: DataFrame, queries: DataFrame, k: int = DEFAULT_K, *,
                image_dim: int, text_col: str = "query_text", **knn_opts) -> DataFrame:
    """Text search, one or many queries: (query_text, rank, product fields,
    distance, score=1/(1+d), similarity=1-d/2). Empty queries give nothing.

    ``catalog`` must carry ``vector`` (see ``embed.product_vectors``).
    """
    q = queries.filter(F.length(F.trim(F.col(text_col))) > 0)
    qv = query_vectors(q.select(text_col).distinct(), text_col, image_dim)
    hits = similarity_topk(catalog, qv, k, item_id="product_id", item_vec="vector",
                           query_id=text_col, query_vec="vector", **knn_opts)
    return _results(hits, catalog).withColumnRenamed("query_id", text_col)


def recommend_all(interactions: DataFrame, catalog: DataFrame, k: int = DEFAULT_K, *,
                  image_dim: int, **knn_opts) -> DataFrame:
    """Recommendations for every user with history:
    (user_id, rank, product fields, distance, score, similarity, profile_text).

    Items compete only within the user's top categories (filtered k-NN).
    """
    return recommend_from_affinity(category_affinity(interactions, catalog), catalog, k, image_dim=image_dim, **knn_opts)


def recommend_from_affinity(affinity: DataFrame, catalog: DataFrame, k: int = DEFAULT_K, *,
                            image_dim: int, **knn_opts) -> DataFrame:
    """As ``recommend_all``, from counts (user_id, category, n) that are already there (``streaming.affinity``)."""
    profiles = user_profiles(top_categories(affinity))
    # A profile is keyed by its ordered category list (names may hold spaces,
    # so the joined text alone is not a key). Profiles are read twice (the
    # distinct queries, the join back to users): computed once.
    profiles = materialize(profiles.withColumn("profile_key", F.to_json("categories")), "user-profiles")
    distinct_profiles = profiles.select("profile_key", "categories", "profile_text").distinct()
    qv = query_vectors(distinct_profiles, "profile_text", image_dim)
    hits = similarity_topk(catalog, qv, k, item_id="product_id", item_vec="vector",
                           item_group="category", query_id="profile_key", query_vec="vector",
                           query_allowed="categories", **knn_opts)
    per_profile = _results(hits, catalog).withColumnRenamed("query_id", "profile_key")
    return (profiles.select("user_id", "profile_key", "profile_text")
            .join(per_profile, "profile_key", "inner").drop("profile_key"))


def recommend_user(interactions: DataFrame, catalog: DataFrame, user_id, k: int = DEFAULT_K, *,
                   image_dim: int, **knn_opts) -> DataFrame:
    """Recommendations for one user; empty for a user without history.
    The user filter is pushed to the interaction scan."""
    mine = interactions.filter(F.col("user_id") == F.lit(user_id))
    return recommend_all(mine, catalog, k, image_dim=image_dim, **knn_opts)
