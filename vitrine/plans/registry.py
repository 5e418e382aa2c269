"""Registered queries over the driver tables, each with its oracle SQL.

``QUERIES[name](spark, sf_dir)`` returns a DataFrame; ``ORACLE[name]`` is the
same result written as DuckDB SQL over the raw tables. Every query reads
whole tables. Computed columns carry the same names on both sides;
distances and other computed floats are rounded to 6 decimals on both sides,
and scores are derived from the rounded distance without further rounding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions.text import TEXT_DIM, product_text
from vitrine.functions.vectors import (cosine_distance, l2_norm, round6, score_halved,
                                       score_inverse, with_unit_vector)
from vitrine.operators import analytics, cells, clean, embed, knn, lsa, recommend
from vitrine.plans import build as build_plan
from vitrine.plans.sql_parts import (AFF, EVENTS, INTER, PROD, PRODUCT_TEXT, PROF, RAW, TOP,
                                     IMAGE_DIM_SQL, TITLE, TOKENS_SQL, hashed_terms, product_norms)
from vitrine.schemas import INTERACTIONS, PRODUCTS
from vitrine.session import materialize, scratch_path
from vitrine.sources import files, pictures, tables, versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Fixed parameters of the point queries and the k of each search.
LOOKUP_PRODUCT_ID = "P00001"
RECOMMEND_USER_ID = "U00028"  # a user with history at every test scale
KNN_QUERY_VEC_ID = 0
KNN_K = 5
SEARCH_K = 10
RECOMMEND_K = 10
LSH_K = 5


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes)


# --------------------------------------------------------------------------
# shared inputs
# --------------------------------------------------------------------------

# Columns that decide whether a product is kept (and which copy).
CORE_COLUMNS = ["product_id", "title", "category", "price"]


def catalog(spark: SparkSession, sf: str, full: bool = False) -> DataFrame:
    """Cleaned, deduplicated catalogue (the served products table).

    Validity and dedup depend only on id, title, category and price, so
    unless ``full`` is asked for, only those columns are read and carried
    through the dedup aggregate (the others come out as typed nulls).
    """
    products = tables.products(spark, sf)
    return clean.clean_products(products if full else products.select(*CORE_COLUMNS))


def image_dim(spark: SparkSession, sf: str) -> int:
    """Declared length of the image vectors; others are rejects."""
    return tables.IMAGE_DIM


def catalog_vectors(spark: SparkSession, sf: str, reuse: bool = False) -> tuple[DataFrame, int]:
    """Catalogue with [text, image] vectors. ``reuse`` materialises it once
    for queries that read it several times (k-NN items, result fields,
    affinity)."""
    dim = image_dim(spark, sf)
    vecs = embed.product_vectors(catalog(spark, sf), tables.image_vectors(spark, sf), dim)
    if reuse:
        vecs = materialize(vecs.select("product_id", "title", "category", "price", "vector"),
                           "catalog-vectors")
    return vecs, dim


# --------------------------------------------------------------------------
# recommendation path: affinity and top categories (flagship)
# --------------------------------------------------------------------------

@register("user_top_categories", _with(PROD, INTER, AFF, TOP) + """
SELECT user_id, category, n, rank FROM top""")
def user_top_categories(spark, sf):
    """Flagship: each user's three most frequent categories (ties by name) over the cleaned catalogue."""
    aff = recommend.category_affinity(tables.interactions(spark, sf), catalog(spark, sf))
    return recommend.top_categories(aff).select("user_id", "category", "n", "rank")


@register("user_category_affinity", _with(PROD, INTER, AFF) + """
SELECT user_id, category, n FROM aff""")
def user_category_affinity(spark, sf):
    """Interactions per (user, category) that reach the cleaned catalogue."""
    return recommend.category_affinity(tables.interactions(spark, sf), catalog(spark, sf))


@register("interactions_enriched", _with(PROD, INTER) + """
SELECT i.user_id, i.product_id, i.interaction_type, i.ts, p.title, p.category, p.price
FROM inter i JOIN prod p ON i.product_id = p.product_id""")
def interactions_enriched(spark, sf):
    """Interactions joined to their product's title, category and price."""
    return recommend.interactions_enriched(tables.interactions(spark, sf), catalog(spark, sf)).select(
        "user_id", "product_id", "interaction_type", "ts", "title", "category", "price")


@register("user_profile_text", _with(PROD, INTER, AFF, TOP, PROF) + """
SELECT user_id, profile_text FROM prof""")
def user_profile_text(spark, sf):
    """Each user's top categories joined by spaces (the recommendation query text)."""
    aff = recommend.category_affinity(tables.interactions(spark, sf), catalog(spark, sf))
    return recommend.user_profiles(recommend.top_categories(aff)).select("user_id", "profile_text")


@register("cold_start_users", _with(PROD, INTER, AFF) + """
SELECT DISTINCT user_id FROM inter WHERE user_id NOT IN (SELECT user_id FROM aff)""")
def cold_start_users(spark, sf):
    """Users whose interactions reach no catalogue product."""
    inter = tables.interactions(spark, sf)
    aff = recommend.category_affinity(inter, catalog(spark, sf))
    return recommend.cold_start_users(analytics.distinct_users(inter), aff)


@register("orphan_interactions", _with(PROD, INTER) + """
SELECT count(*) AS n_interactions,
       count(*) FILTER (WHERE product_id NOT IN (SELECT product_id FROM prod)) AS n_orphans
FROM inter""")
def orphan_interactions(spark, sf):
    """Interaction count and how many point at products outside the catalogue."""
    inter = tables.interactions(spark, sf)
    n_orph = recommend.orphan_interactions(inter, catalog(spark, sf)).select(F.count(F.lit(1))).scalar()
    return inter.agg(F.count(F.lit(1)).alias("n_interactions")).withColumn("n_orphans", n_orph)


@register("distinct_users", _with(INTER) + """
SELECT DISTINCT user_id FROM inter WHERE user_id IS NOT NULL""")
def distinct_users(spark, sf):
    """The users table: distinct user ids of the interaction log."""
    return analytics.distinct_users(tables.interactions(spark, sf))


@register("product_lookup", _with(PROD) + f"""
SELECT * FROM prod WHERE product_id = '{LOOKUP_PRODUCT_ID}'""")
def product_lookup(spark, sf):
    """Point lookup of one product id in the cleaned catalogue (empty when absent)."""
    return catalog(spark, sf, full=True).filter(F.col("product_id") == F.lit(LOOKUP_PRODUCT_ID))


# --------------------------------------------------------------------------
# analytics page
# --------------------------------------------------------------------------

@register("category_counts", _with(PROD) + """
SELECT category, count(*) AS count FROM prod WHERE category IS NOT NULL GROUP BY 1""")
def category_counts(spark, sf):
    """Products per category, most frequent first."""
    return analytics.category_counts(catalog(spark, sf))


@register("interaction_type_counts", _with(EVENTS) + """
SELECT interaction_type, count(*) AS count FROM ev WHERE interaction_type IS NOT NULL GROUP BY 1""")
def interaction_type_counts(spark, sf):
    """Events per interaction type, most frequent first."""
    return analytics.interaction_type_counts(tables.event_log(spark, sf))


@register("interaction_type_share", _with(EVENTS) + """
SELECT interaction_type, count(*) AS count,
       round(count(*) / (SELECT count(*) FROM ev WHERE interaction_type IS NOT NULL), 6) AS share
FROM ev WHERE interaction_type IS NOT NULL GROUP BY 1""")
def interaction_type_share(spark, sf):
    """Events per interaction type and their share of all typed events."""
    return analytics.interaction_type_share(tables.event_log(spark, sf))


@register("catalog_metrics", _with(PROD, EVENTS) + """
SELECT count(*) AS n_products, count(DISTINCT category) AS n_categories,
       round(avg(price), 6) AS avg_price, (SELECT count(*) FROM ev) AS n_interactions
FROM prod""")
def catalog_metrics(spark, sf):
    """Products, distinct categories, mean price and number of events, in one row."""
    return analytics.catalog_metrics(catalog(spark, sf), tables.event_log(spark, sf))


@register("formatted_metrics", _with(PROD, EVENTS) + """
SELECT interaction_type,
       printf('%.1f%%', round(round(count(*) / (SELECT count(*) FROM ev WHERE interaction_type IS NOT NULL), 6) * 100.0, 1)) AS share_text,
       printf('$%.2f', round((SELECT avg(price) FROM prod), 2)) AS avg_price_text
FROM ev WHERE interaction_type IS NOT NULL GROUP BY 1""")
def formatted_metrics(spark, sf):
    """Share per interaction type as `%.1f%%` and the mean price as `$%.2f`."""
    return analytics.formatted_metrics(catalog(spark, sf), tables.event_log(spark, sf))


@register("price_histogram", _with(PROD) + """,
pr AS (SELECT price FROM prod WHERE price IS NOT NULL AND NOT isnan(price) AND NOT isinf(price)),
mm AS (SELECT min(price) AS lo, max(price) AS hi FROM pr),
binned AS (
  SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((price - lo) / (hi - lo) * 30), 29) END AS BIGINT) AS bin
  FROM pr, mm)
SELECT r.bin, round(lo + r.bin * ((hi - lo) / 30), 6) AS bin_lo,
       round(CASE WHEN hi = lo THEN hi ELSE lo + (r.bin + 1) * ((hi - lo) / 30) END, 6) AS bin_hi,
       (SELECT count(*) FROM binned b WHERE b.bin = r.bin) AS count
FROM range(30) r(bin), mm
UNION ALL SELECT NULL, NULL, NULL, (SELECT count(*) FROM prod) - (SELECT count(*) FROM pr)""")
def price_histogram(spark, sf):
    """30 equal-width price bins between the lowest and highest price, and the number of unbinned rows."""
    return analytics.price_histogram(catalog(spark, sf))


@register("recent_interactions", _with(EVENTS) + """
SELECT * FROM ev ORDER BY ts DESC, event_id DESC LIMIT 10""")
def recent_interactions(spark, sf):
    """The ten most recent events."""
    return analytics.recent_interactions(tables.event_log(spark, sf))


# --------------------------------------------------------------------------
# cleaning
# --------------------------------------------------------------------------

@register("clean_products", _with(RAW) + """,
valid AS (SELECT * FROM classified WHERE reason IS NULL),
kept AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY product_id) AS rn FROM valid)
SELECT product_id, title, CAST(NULL AS VARCHAR) AS description, category, brand,
       price_value AS price, CAST(NULL AS DOUBLE) AS rating, CAST(NULL AS INTEGER) AS num_reviews
FROM kept WHERE rn = 1""")
def clean_products(spark, sf):
    """Raw text catalogue cleaned: complete rows, numeric positive price, one row per title."""
    return clean.clean_products(tables.raw_products(spark, sf))


@register("clean_rejects", _with(RAW) + """,
valid AS (SELECT * FROM classified WHERE reason IS NULL),
copies AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY product_id, price_text) AS rn FROM valid)
SELECT product_id, title, price_text, reason FROM classified WHERE reason IS NOT NULL
UNION ALL
SELECT product_id, title, price_text, 'duplicate_title' AS reason FROM copies WHERE rn > 1""")
def clean_rejects(spark, sf):
    """Raw rows set aside by the cleaning, with their reason."""
    return clean.clean_rejects(tables.raw_products(spark, sf))


@register("clean_audit", _with(RAW) + """
SELECT count(*) AS n_read,
       count(*) FILTER (WHERE reason = 'missing_id') AS n_missing_id,
       count(*) FILTER (WHERE reason = 'missing_field') AS n_missing_field,
       count(*) FILTER (WHERE reason = 'bad_price') AS n_bad_price,
       count(*) FILTER (WHERE reason = 'non_positive_price') AS n_non_positive_price,
       count(*) FILTER (WHERE reason IS NULL) AS n_valid,
       count(DISTINCT title) FILTER (WHERE reason IS NULL) AS n_clean,
       count(*) FILTER (WHERE reason IS NULL) - count(DISTINCT title) FILTER (WHERE reason IS NULL) AS n_duplicate_title
FROM classified""")
def clean_audit(spark, sf):
    """Row counts per cleaning stage, in one row."""
    return clean.clean_audit(tables.raw_products(spark, sf))


@register("dedup_titles", f"""
SELECT title, min(product_id) AS product_id, count(*) AS n_copies
FROM (SELECT *, {TITLE} AS title, printf('P%05d', p_partkey) AS product_id FROM part)
WHERE title IS NOT NULL AND p_type IS NOT NULL AND p_retailprice IS NOT NULL
  AND NOT isnan(p_retailprice) AND p_retailprice > 0
  AND title NOT IN ({TOKENS_SQL}) AND p_type NOT IN ({TOKENS_SQL})
GROUP BY 1""")
def dedup_titles(spark, sf):
    """Per title: the product id kept and the number of copies."""
    c = clean.classify(tables.products(spark, sf).select(*CORE_COLUMNS))
    valid = c.filter(F.col("reason").isNull()).drop("reason", "price_text")
    return clean.dedup_titles(valid).select("title", "product_id", F.col("n_copies").cast("long"))


# --------------------------------------------------------------------------
# text and vectors
# --------------------------------------------------------------------------

@register("product_text", _with(PROD) + """
SELECT product_id, concat_ws(' ', coalesce(title, ''), coalesce(category, '')) AS text FROM prod""")
def product_text_q(spark, sf):
    """Each catalogue product's text: title and category."""
    return catalog(spark, sf).select("product_id", product_text(F.col("title"), F.col("category")).alias("text"))


@register("hash_embed", _with(PROD, hashed_terms("pt", "prod", "product_id", PRODUCT_TEXT)) + """
SELECT t.k AS product_id, t.b AS bucket, round(t.c / sqrt(s.sq), 6) AS weight
FROM pt_term t JOIN pt_sq s ON t.k = s.k WHERE s.sq > 0""")
def hash_embed(spark, sf):
    """Hashed bag-of-words text vectors, as non-zero (bucket, unit weight) entries."""
    prod = catalog(spark, sf).withColumn("text", product_text(F.col("title"), F.col("category")))
    return embed.hashed_terms(prod, "product_id", "text")


LSA_RANK = 8


@register("lsa_embed")
def lsa_embed(spark, sf):
    """Each product's text in the leading latent dimensions of the whole catalogue: squared coordinates, since a
    singular vector's sign is free, and the vector's length. (An SVD is beyond SQL; tests compare it with numpy.)"""
    prod = catalog(spark, sf).withColumn("text", product_text(F.col("title"), F.col("category")))
    model = lsa.fit(prod, "product_id", "text", LSA_RANK)
    vec = lsa.embed(prod, "product_id", "text", model)
    return vec.select("product_id", F.transform("lsa_vec", lambda x: F.round(x * x, 6)).alias("squares"),
                      round6(l2_norm(F.col("lsa_vec"))).alias("length"))


def _vector_entries_sql(value_expr: str) -> str:
    """Non-zero entries of each product's [text, image] vector as
    (product_id, idx, value); ``value_expr`` may use ``e.v`` and ``pn.nrm``."""
    return _with(PROD, hashed_terms("pt", "prod", "product_id", PRODUCT_TEXT),
                 product_norms().strip("\n")) + f""",
entries AS (
  SELECT k AS product_id, b AS idx, c AS v FROM pt_term
  UNION ALL
  SELECT i.product_id, {TEXT_DIM} + u.pos - 1 AS idx, u.v
  FROM img i JOIN prod p ON p.product_id = i.product_id,
       LATERAL (SELECT unnest(i.e) AS v, generate_subscripts(i.e, 1) AS pos) u)
SELECT e.product_id, CAST(e.idx AS BIGINT) AS idx, {value_expr} AS value
FROM entries e JOIN pn ON pn.product_id = e.product_id
WHERE e.v <> 0"""


@register("combined_vectors", _vector_entries_sql("round(e.v, 6)"))
def combined_vectors(spark, sf):
    """Non-zero entries of each product's [text, image] vector."""
    vecs, _ = catalog_vectors(spark, sf)
    return (vecs.select("product_id", F.posexplode("vector").alias("idx", "v"))
            .filter(F.col("v") != 0)
            .select("product_id", F.col("idx").cast("long").alias("idx"),
                    round6(F.col("v").cast("double")).alias("value")))


@register("l2_normalize", _vector_entries_sql("round(e.v / (pn.nrm + 1e-8), 6)"))
def l2_normalize(spark, sf):
    """Non-zero entries of each product's vector divided by (norm + 1e-8)."""
    vecs, _ = catalog_vectors(spark, sf)
    unit = with_unit_vector(vecs, "vector", "unit", "norm", as_float=False)
    return (unit.select("product_id", F.posexplode("unit").alias("idx", "v"))
            .filter(F.col("v") != 0)
            .select("product_id", F.col("idx").cast("long").alias("idx"),
                    round6(F.col("v")).alias("value")))


# --------------------------------------------------------------------------
# k-NN over the labelled vectors
# --------------------------------------------------------------------------

VEC = """
v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
         sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS nrm
  FROM embeddings WHERE embedding IS NOT NULL)"""


QUERY_SET = "AND q.vec_id % 100 = 0"


def _query_set(vec: DataFrame) -> DataFrame:
    """The stated queries of a search: the rows whose id is divisible by 100."""
    return vec.filter(F.pmod("vec_id", F.lit(100)) == 0)


def _knn_sql(k: int, extra_where: str = "", query_where: str = "") -> str:
    return _with(VEC) + f""",
pairs AS (
  SELECT q.vec_id AS query_id, x.vec_id AS item_id,
         round(greatest(1 - list_dot_product(q.e, x.e) / (q.nrm * x.nrm), 0), 6) AS distance
  FROM v q, v x WHERE q.nrm > 0 AND x.nrm > 0 {extra_where} {query_where}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank FROM pairs)
SELECT query_id, item_id, distance, rank,
       1 / (1 + distance) AS score, 1 - distance / 2 AS similarity
FROM ranked WHERE rank <= {k}"""


def _with_scores(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "item_id", "distance", "rank",
                       score_inverse(F.col("distance")).alias("score"),
                       score_halved(F.col("distance")).alias("similarity"))


@register("knn_batch", _knn_sql(KNN_K, "", QUERY_SET))
def knn_batch(spark, sf):
    """The 5 nearest of all vectors for every hundredth one (the stated query set)."""
    vec = tables.vectors(spark, sf)
    hits = knn.similarity_topk(vec, _query_set(vec), KNN_K, item_id="vec_id", item_vec="embedding",
                               query_id="vec_id", query_vec="embedding")
    return _with_scores(hits)


@register("knn_filtered", _knn_sql(KNN_K, "AND x.label = q.label", QUERY_SET))
def knn_filtered(spark, sf):
    """The 5 nearest vectors of every hundredth one among those with the same label (equi-join on it)."""
    vec = tables.vectors(spark, sf)
    queries = _query_set(vec).withColumn("allowed", F.array("label"))
    hits = knn.similarity_topk(vec, queries, KNN_K, item_id="vec_id", item_vec="embedding",
                               item_group="label", query_id="vec_id", query_vec="embedding",
                               query_allowed="allowed")
    return _with_scores(hits)


@register("knn_blocked", _knn_sql(KNN_K, "", QUERY_SET))
def knn_blocked(spark, sf):
    """The batch k-NN through the blocked (any-size) path, with blocks small
    enough that the test tables are cut into several item and query blocks."""
    vec = tables.vectors(spark, sf)
    hits = knn.similarity_topk(vec, _query_set(vec), KNN_K, item_id="vec_id", item_vec="embedding",
                               query_id="vec_id", query_vec="embedding", strategy="blocked",
                               block_rows=250, query_block_rows=3)
    return _with_scores(hits)


@register("knn_single", _knn_sql(SEARCH_K, "", f"AND q.vec_id = {KNN_QUERY_VEC_ID}"))
def knn_single(spark, sf):
    """One query vector (taken from the table) against all vectors, in JVM
    expressions: distance column, then a top-k sort (TakeOrderedAndProject)."""
    vec = tables.vectors(spark, sf)
    row = vec.filter(F.col("vec_id") == KNN_QUERY_VEC_ID).select("embedding").first()
    q = [] if row is None or row["embedding"] is None else [float(x) for x in row["embedding"]]
    qcol = F.array(*[F.lit(x) for x in q]) if q else F.array().cast("array<double>")
    qnorm = float(sum(x * x for x in q)) ** 0.5
    scored = (vec.filter(knn.rankable("embedding")).withColumn("norm", l2_norm(F.col("embedding")))
              .withColumn("distance", round6(cosine_distance(F.col("embedding"), qcol,
                                                             F.col("norm"), F.lit(qnorm))))
              .filter(F.col("distance").isNotNull()))
    if not q:
        scored = scored.limit(0)
    top = scored.orderBy("distance", "vec_id").limit(SEARCH_K)
    ranked = top.withColumn("rank", F.row_number().over(
        Window.orderBy("distance", "vec_id")).cast("long"))
    return _with_scores(ranked.select(F.lit(KNN_QUERY_VEC_ID).cast("long").alias("query_id"),
                                      F.col("vec_id").alias("item_id"), "distance", "rank"))


# LSH parameters of the registered query; the oracle restates its buckets for
# the 64-dimensional vectors of the test tables.
LSH_TABLES, LSH_BITS, LSH_SEED, LSH_ORACLE_DIM = 20, 4, 7, 64


def _lsh_sql() -> str:
    planes = knn.hyperplanes(LSH_ORACLE_DIM, LSH_TABLES, LSH_BITS, LSH_SEED)
    values = ",\n  ".join(
        f"({t}, {j}, [{', '.join(repr(float(x)) for x in planes[t, j])}]::DOUBLE[])"
        for t in range(LSH_TABLES) for j in range(LSH_BITS))
    return _with(VEC) + f""",
planes(tbl, bit, r) AS (VALUES
  {values}),
sig AS (
  SELECT v.vec_id, p.tbl,
         sum(CASE WHEN list_dot_product(v.e, p.r) >= 0 THEN (1 << p.bit) ELSE 0 END) AS bucket
  FROM v, planes p GROUP BY 1, 2),
cand AS (
  SELECT DISTINCT a.vec_id AS query_id, b.vec_id AS item_id
  FROM sig a JOIN sig b ON a.tbl = b.tbl AND a.bucket = b.bucket WHERE a.vec_id % 100 = 0),
pairs AS (
  SELECT c.query_id, c.item_id,
         round(greatest(1 - list_dot_product(q.e, x.e) / (q.nrm * x.nrm), 0), 6) AS distance
  FROM cand c JOIN v q ON q.vec_id = c.query_id JOIN v x ON x.vec_id = c.item_id
  WHERE q.nrm > 0 AND x.nrm > 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank FROM pairs)
SELECT query_id, item_id, distance, rank,
       1 / (1 + distance) AS score, 1 - distance / 2 AS similarity
FROM ranked WHERE rank <= {LSH_K}"""


@register("knn_lsh", _lsh_sql())
def knn_lsh(spark, sf):
    """Approximate top-k by random-hyperplane LSH: exact ranking among the
    items that share a bucket with the query in any table."""
    vec = tables.vectors(spark, sf)
    dim = image_dim(spark, sf)
    hits = knn.lsh_topk(vec, _query_set(vec), LSH_K, dim=dim, n_tables=LSH_TABLES, n_bits=LSH_BITS,
                        seed=LSH_SEED, item_id="vec_id", item_vec="embedding",
                        query_id="vec_id", query_vec="embedding")
    return _with_scores(hits)


@register("knn_cells", _knn_sql(KNN_K, "", QUERY_SET))
def knn_cells(spark, sf):
    """The batch k-NN from an inverted-list index with error bounds: exact, with few pairs scored."""
    vec = tables.vectors(spark, sf)
    index = cells.build_cells(vec, dim=image_dim(spark, sf), item_id="vec_id", item_vec="embedding")
    hits, _ = cells.cell_topk(index, _query_set(vec), KNN_K, query_id="vec_id", query_vec="embedding")
    return _with_scores(hits)


# --------------------------------------------------------------------------
# search and recommendation
# --------------------------------------------------------------------------

def _search_sql() -> str:
    return _with(
        PROD,
        hashed_terms("pt", "prod", "product_id", PRODUCT_TEXT),
        product_norms().strip("\n"),
        """
q AS (SELECT DISTINCT """ + TITLE + """ AS query_text FROM part WHERE p_partkey % 100 = 0)""",
        hashed_terms("qt", "q", "query_text", "lower(query_text)"),
    ) + f""",
dots AS (
  SELECT a.k AS query_text, b.k AS product_id, sum(a.c * b.c) AS dot
  FROM qt_term a JOIN pt_term b ON a.b = b.b GROUP BY 1, 2),
cand AS (
  SELECT q.query_text, p.product_id, p.title, p.category, p.price,
         round(greatest(1 - coalesce(d.dot, 0) / (sqrt(qs.sq) * pn.nrm), 0), 6) AS distance
  FROM q JOIN qt_sq qs ON qs.k = q.query_text
  CROSS JOIN prod p JOIN pn ON pn.product_id = p.product_id
  LEFT JOIN dots d ON d.query_text = q.query_text AND d.product_id = p.product_id
  WHERE qs.sq > 0 AND pn.nrm > 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_text ORDER BY distance, product_id) AS rank FROM cand)
SELECT query_text, rank, product_id, coalesce(title, '') AS title, coalesce(category, '') AS category,
       coalesce(price, 0.0) AS price, distance,
       1 / (1 + distance) AS score, 1 - distance / 2 AS similarity
FROM ranked WHERE rank <= {SEARCH_K}"""


@register("search_text", _search_sql())
def search_text(spark, sf):
    """Batch text search: the titles of the parts whose key is divisible by 100
    are the queries, over all of the catalogue's [hashed text, image] vectors."""
    vecs, dim = catalog_vectors(spark, sf, reuse=True)
    queries = (tables.read_table(spark, sf, "part").filter(F.pmod("p_partkey", F.lit(100)) == 0)
               .select(tables.part_title().alias("query_text")))
    return recommend.search_text(vecs, queries, SEARCH_K, image_dim=dim)


def _recommend_sql(user_filter: str = "") -> str:
    return _with(
        PROD, INTER.rstrip().rstrip(")") + user_filter + ")",
        AFF, TOP, PROF,
        hashed_terms("pt", "prod", "product_id", PRODUCT_TEXT),
        product_norms().strip("\n"),
        """
qp AS (SELECT DISTINCT profile_text, categories FROM prof)""",
        hashed_terms("qt", "qp", "profile_text", "lower(profile_text)"),
    ) + f""",
dots AS (
  SELECT a.k AS profile_text, b.k AS product_id, sum(a.c * b.c) AS dot
  FROM qt_term a JOIN pt_term b ON a.b = b.b GROUP BY 1, 2),
cand AS (
  SELECT qp.profile_text, p.product_id, p.title, p.category, p.price,
         round(greatest(1 - coalesce(d.dot, 0) / (sqrt(qs.sq) * pn.nrm), 0), 6) AS distance
  FROM qp JOIN qt_sq qs ON qs.k = qp.profile_text
  JOIN prod p ON list_contains(qp.categories, p.category)
  JOIN pn ON pn.product_id = p.product_id
  LEFT JOIN dots d ON d.profile_text = qp.profile_text AND d.product_id = p.product_id
  WHERE qs.sq > 0 AND pn.nrm > 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY profile_text ORDER BY distance, product_id) AS rank FROM cand)
SELECT u.user_id, u.profile_text, r.rank, r.product_id, coalesce(r.title, '') AS title,
       coalesce(r.category, '') AS category, coalesce(r.price, 0.0) AS price, r.distance,
       1 / (1 + r.distance) AS score, 1 - r.distance / 2 AS similarity
FROM prof u JOIN ranked r ON r.profile_text = u.profile_text WHERE r.rank <= {RECOMMEND_K}"""


@register("recommend_all", _recommend_sql())
def recommend_all(spark, sf):
    """Ten recommendations for every user with history, within the user's top categories."""
    vecs, dim = catalog_vectors(spark, sf, reuse=True)
    return recommend.recommend_all(tables.interactions(spark, sf), vecs, RECOMMEND_K, image_dim=dim)


@register("recommend_user", _recommend_sql(f" WHERE printf('U%05d', o.o_custkey) = '{RECOMMEND_USER_ID}'"))
def recommend_user(spark, sf):
    """Ten recommendations for one user (filter pushed to the interaction scan)."""
    vecs, dim = catalog_vectors(spark, sf, reuse=True)
    return recommend.recommend_user(tables.interactions(spark, sf), vecs, RECOMMEND_USER_ID,
                                    RECOMMEND_K, image_dim=dim, strategy="broadcast")      # one profile


# --------------------------------------------------------------------------
# build, tables, round trips (written under the shared folder, read back)
# --------------------------------------------------------------------------

def _build(spark, sf, steps=build_plan.STEPS):
    return build_plan.build(spark, tables.raw_products(spark, sf), tables.interactions(spark, sf),
                            tables.image_vectors(spark, sf), image_dim(spark, sf), steps=steps)


RAW_CLEAN = """
valid AS (SELECT * FROM classified WHERE reason IS NULL),
rawclean AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY product_id) AS rn FROM valid)
  WHERE rn = 1)"""


@register("catalog_build", _with(RAW, RAW_CLEAN, INTER) + """
SELECT 'clean' AS step, 'products_clean' AS "table", count(*) AS n_rows FROM rawclean
UNION ALL SELECT 'embed', 'vectors', count(*) FROM rawclean
UNION ALL SELECT 'tables', 'products', count(*) FROM rawclean
UNION ALL SELECT 'tables', 'interactions', count(*) FROM inter
UNION ALL SELECT 'tables', 'users', count(DISTINCT user_id) FROM inter""")
def catalog_build(spark, sf):
    """Runs clean -> embed -> vector table -> tables; rows read back per table."""
    _, audit = _build(spark, sf)
    return audit


@register("table_status", _with(RAW, RAW_CLEAN, INTER) + """
SELECT 'products' AS "table", count(*) AS n_rows, count(*) FILTER (WHERE product_id IS NULL) AS n_null_keys,
       CAST(0 AS BIGINT) AS n_orphans, count(*) > 0 AND count(*) FILTER (WHERE product_id IS NULL) = 0 AS ready
FROM rawclean
UNION ALL
SELECT 'vectors', count(*), 0, 0, count(*) > 0 FROM rawclean
UNION ALL
SELECT 'interactions', count(*), count(*) FILTER (WHERE product_id IS NULL),
       count(*) FILTER (WHERE product_id NOT IN (SELECT product_id FROM rawclean)),
       count(*) > 0 AND count(*) FILTER (WHERE product_id IS NULL) = 0
FROM inter
UNION ALL
SELECT 'users', count(DISTINCT user_id), 0, 0, count(DISTINCT user_id) > 0 FROM inter""")
def table_status(spark, sf):
    """Runs the build, then reports rows, null keys, orphans and readiness per table."""
    out, _ = _build(spark, sf)
    return build_plan.table_status(spark, out)


@register("vector_table", _with(PROD, hashed_terms("pt", "prod", "product_id", PRODUCT_TEXT),
                               product_norms().strip("\n")) + f"""
SELECT CAST(p.product_id AS VARCHAR) AS id, p.product_id, p.title, p.category, p.price,
       concat_ws(' ', coalesce(p.title, ''), coalesce(p.category, '')) AS document,
       round(pn.nrm, 6) AS norm, CAST({TEXT_DIM} + {IMAGE_DIM_SQL} AS BIGINT) AS dim
FROM prod p JOIN pn ON pn.product_id = p.product_id""")
def vector_table(spark, sf):
    """Writes the vector collection (by category) and reads back its rows and norms."""
    vecs, _ = catalog_vectors(spark, sf)
    path = scratch_path(spark, "vector-table")
    build_plan.write_vector_table(build_plan.vector_table(vecs), path)
    back = files.read_parquet(spark, path)
    return back.select("id", "product_id", "title", "category", "price", "document",
                       round6(F.col("norm")).alias("norm"), F.size("unit_vector").cast("long").alias("dim"))


@register("build_tables", _with(PROD, INTER) + """
SELECT 'products' AS "table", count(*) AS n_rows FROM prod
UNION ALL SELECT 'interactions', count(*) FROM inter
UNION ALL SELECT 'users', count(DISTINCT user_id) FROM inter""")
def build_tables(spark, sf):
    """Writes the products, interactions and users tables and reads back their row counts."""
    root = scratch_path(spark, "tables")
    prods = catalog(spark, sf, full=True)
    inter = tables.interactions(spark, sf)
    files.write_parquet(prods, f"{root}/products")
    files.write_parquet(inter, f"{root}/interactions")
    # users come from the interactions just written, not from a second join
    written = files.read_parquet(spark, f"{root}/interactions", inter.schema)
    files.write_parquet(analytics.distinct_users(written), f"{root}/users")

    def n(name):
        return files.read_parquet(spark, f"{root}/{name}").agg(
            F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
    return n("products").unionByName(n("interactions")).unionByName(n("users"))


@register("csv_roundtrip", _with(PROD) + """
SELECT * FROM prod""")
def csv_roundtrip(spark, sf):
    """The cleaned catalogue written as CSV and read back with its declared schema."""
    path = scratch_path(spark, "products-csv")
    files.write_csv(catalog(spark, sf, full=True), path)
    return files.read_csv(spark, path, PRODUCTS)


@register("parquet_roundtrip", _with(PROD) + """
SELECT * FROM prod""")
def parquet_roundtrip(spark, sf):
    """The cleaned catalogue written as Parquet and read back."""
    path = scratch_path(spark, "products-parquet")
    files.write_parquet(catalog(spark, sf, full=True), path)
    return files.read_parquet(spark, path, PRODUCTS)


@register("vector_rejects", """
SELECT id, reason FROM (
  SELECT vec_id AS id, CASE WHEN v IS NULL THEN 'missing_vector' WHEN len(v) <> 64 THEN 'wrong_length'
      WHEN len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'not_finite'
      WHEN len(list_filter(v, lambda x: x <> 0)) = 0 THEN 'zero_vector' END AS reason
  FROM (SELECT vec_id, CASE vec_id % 50 WHEN 1 THEN NULL WHEN 2 THEN embedding[1:63]
      WHEN 3 THEN list_concat(embedding[1:63], [NULL::FLOAT]) WHEN 4 THEN list_concat(embedding[1:63], ['NaN'::FLOAT])
      WHEN 5 THEN list_transform(embedding, lambda x: 0::FLOAT) ELSE embedding END AS v FROM embeddings))
WHERE reason IS NOT NULL""")
def vector_rejects(spark, sf):
    """Vectors that cannot take part in a search, with the reason, from a table with faulty rows."""
    return embed.vector_rejects(tables.faulty_vectors(spark, sf), "id", "vector", tables.IMAGE_DIM)


@register("interactions_csv", _with(INTER) + """
SELECT user_id, product_id, interaction_type, ts FROM inter""")
def interactions_csv(spark, sf):
    """All interactions written as a CSV export and read back into the interactions table's shape."""
    path = scratch_path(spark, "interactions-csv")
    files.write_csv(tables.interactions(spark, sf).withColumnRenamed("ts", "timestamp"), path)
    return files.read_interactions_csv(spark, path)


AWKWARD = """SELECT printf('P%05d', p_partkey) AS product_id,
  CASE p_partkey % 7 WHEN 0 THEN 'say "hi", ' || p_name WHEN 1 THEN p_name || chr(10) || 'second line'
    WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN ' ' || p_name || ' ' WHEN 5 THEN '"' ELSE p_name END AS title,
  p_brand AS brand, p_retailprice AS price FROM part"""


@register("csv_awkward_text", AWKWARD)
def csv_awkward_text(spark, sf):
    """Titles with quotes, commas, line ends, blanks and empty strings written as CSV and read back by
    column name (the reader asks for the columns in another order)."""
    path = scratch_path(spark, "awkward-csv")
    files.write_csv(tables.awkward_titles(spark, sf), path)
    shape = T.StructType([T.StructField("price", T.DoubleType()), *[T.StructField(n, T.StringType())
                                                                   for n in ("brand", "title", "product_id")]])
    return files.read_csv(spark, path, shape).select("product_id", "title", "brand", "price")


@register("build_products", _with(RAW, RAW_CLEAN) + """
SELECT product_id, title, category, brand, price_value AS price FROM rawclean""")
def build_products(spark, sf):
    """Runs the build's products step and returns the rows of the table it wrote."""
    out, _ = _build(spark, sf, ("products",))
    return files.read_parquet(spark, out.products, PRODUCTS).select("product_id", "title", "category", "brand", "price")


@register("build_interactions", _with(INTER) + """
SELECT user_id, product_id, interaction_type, ts FROM inter""")
def build_interactions(spark, sf):
    """Runs the build's interactions step and returns the rows of the table it wrote."""
    out, _ = _build(spark, sf, ("interactions",))
    return files.read_parquet(spark, out.interactions, INTERACTIONS)


@register("build_defaults", f"""
WITH raw AS (SELECT row_number() OVER () - 1 AS id, {TITLE} AS title, p_type AS category FROM part),
kept AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY id) AS rn FROM raw
         WHERE title NOT IN ({TOKENS_SQL}) AND category IS NOT NULL AND category NOT IN ({TOKENS_SQL}))
SELECT CAST(id AS VARCHAR) AS product_id, title, category, CAST(NULL AS VARCHAR) AS brand, CAST(0 AS DOUBLE) AS price
FROM kept WHERE rn = 1""")
def build_defaults(spark, sf):
    """Builds the products table of a catalogue without ids, brands and prices: row numbers and defaults stand in."""
    raw = tables.read_table(spark, sf, "part").select(tables.part_title().alias("title"), F.col("p_type").alias("category"))
    out, _ = build_plan.build(spark, raw, None, None, 0, steps=("products",))
    return files.read_parquet(spark, out.products, PRODUCTS).select("product_id", "title", "category", "brand", "price")


@register("replace_versions", _with(PROD) + """
SELECT product_id, title, category, price, CAST(2 AS BIGINT) AS n_loads FROM prod""")
def replace_versions(spark, sf):
    """Loads half of the catalogue, then all of it: the rows of the version in force, and how many versions there are."""
    root, prods = scratch_path(spark, "versioned-products"), catalog(spark, sf)
    versions.replace_table(prods.filter(F.pmod(F.xxhash64("product_id"), F.lit(2)) == 0), root)
    versions.replace_table(prods, root)
    n_loads = len(versions.versions(spark, root))
    return versions.read_table(spark, root).select("product_id", "title", "category", "price",
                                                   F.lit(n_loads).cast("long").alias("n_loads"))


@register("picture_scan", """
WITH p AS (SELECT vec_id, vec_id % 8 AS kind, 10 * length(CAST(vec_id AS VARCHAR)) AS body FROM embeddings)
SELECT CAST(vec_id AS VARCHAR) AS id,
  CAST(CASE WHEN kind <= 2 THEN 29 + body WHEN kind = 3 THEN 10 + body WHEN kind = 4 THEN 30 + body WHEN kind = 5 THEN 18
       ELSE 1 + body END AS BIGINT) AS length,
  CASE WHEN kind IN (0, 1, 2, 5) THEN 'png' WHEN kind = 3 THEN 'gif' WHEN kind = 4 THEN 'jpeg' END AS format,
  CASE WHEN kind <= 4 THEN CAST(vec_id % 1000 + 1 AS INTEGER) END AS width,
  CASE WHEN kind <= 4 THEN CAST(vec_id * 7 % 900 + 1 AS INTEGER) END AS height,
  CASE kind WHEN 5 THEN 'no_size' WHEN 6 THEN 'not_a_picture' END AS fault
FROM p WHERE kind <> 7""")
def picture_scan(spark, sf):
    """Picture files written from the vector table, scanned again: format and size from their headers, broken files told (empty ones, one in eight, aren't scanned)."""
    folder = scratch_path(spark, "pictures")
    pictures.write_picture_files(tables.pictures(spark, sf), folder)
    return pictures.picture_info(files.read_picture_files(spark, folder))


BUCKETS = 16


@register("affinity_bucketed", _with(PROD, INTER, AFF) + """
SELECT user_id, category, n FROM aff""")
def affinity_bucketed(spark, sf):
    """The affinity from tables bucketed by product: the join moves no row of the log."""
    products = build_plan.bucketed(catalog(spark, sf).select("product_id", "category"), "product_id", BUCKETS, "products-by-id")
    log = build_plan.bucketed(tables.interactions(spark, sf).select("product_id", "user_id"), "product_id", BUCKETS, "log-by-product")
    return recommend.category_affinity(log, products.hint("merge"))


@register("product_lookup_written", _with(PROD) + f"""
SELECT * FROM prod WHERE product_id = '{LOOKUP_PRODUCT_ID}'""")
def product_lookup_written(spark, sf):
    """Point lookup in a written products table, clustered by id: the filter reaches the files' statistics."""
    out = build_plan.BuildOutput(scratch_path(spark, "lookup-tables"))
    build_plan.write_products(tables.products(spark, sf), out)
    return files.read_parquet(spark, out.products, PRODUCTS).filter(F.col("product_id") == F.lit(LOOKUP_PRODUCT_ID))


@register("recommend_user_written", _recommend_sql(f" WHERE printf('U%05d', o.o_custkey) = '{RECOMMEND_USER_ID}'"))
def recommend_user_written(spark, sf):
    """Ten recommendations for one user from the written collection and the log clustered by user."""
    out, _ = build_plan.build(spark, tables.products(spark, sf), tables.interactions(spark, sf),
                              tables.image_vectors(spark, sf), image_dim(spark, sf))
    log = files.read_parquet(spark, out.interactions, INTERACTIONS)
    collection = files.read_parquet(spark, out.vectors).select("product_id", "title", "category", "price", "vector")
    return recommend.recommend_user(log, collection, RECOMMEND_USER_ID, RECOMMEND_K, image_dim=image_dim(spark, sf), strategy="broadcast")


@register("embedding_roundtrip", _with(VEC) + """
SELECT vec_id, label, CAST(len(e) AS BIGINT) AS dim, round(nrm, 6) AS norm FROM v""")
def embedding_roundtrip(spark, sf):
    """The labelled vectors written as Parquet and read back (length and norm)."""
    path = scratch_path(spark, "vectors-parquet")
    files.write_parquet(tables.vectors(spark, sf), path)
    back = files.read_parquet(spark, path)
    return back.select("vec_id", "label", F.size("embedding").cast("long").alias("dim"),
                       round6(l2_norm(F.col("embedding"))).alias("norm"))
