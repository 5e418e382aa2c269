"""Search and recommendation requests served as a stream.

The reference answers one HTTP request at a time (a text search with
``top_k``, or the recommendations of one user). Here requests arrive as JSON
lines in a folder; Structured Streaming groups them into micro-batches and
each micro-batch is answered by one batched job with the library's own
operators (``recommend.search_text`` / ``recommend.recommend_all``) -- no new
operator. Answers are written per batch id under an output folder with
overwrite, so a batch replayed after a failure rewrites the same files.

Per-request ``top_k`` (default 10, as in the API) is exact: requests are answered
in classes by the power of two above their ``top_k``, and each keeps its own
first ``top_k`` rows. So one request for a thousand results doesn't make the
others of its batch large, and there are few classes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vitrine.operators import recommend
from vitrine.session import scratch, scratch_path
from vitrine.streaming.affinity import read_affinity

SEARCH_REQUEST = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("top_k", T.IntegerType()),
])

RECOMMEND_REQUEST = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("top_k", T.IntegerType()),
])

NO_HISTORY = "No history for user"  # fixed value: the API's answer for a user without history


def _with_k(requests: DataFrame) -> DataFrame:
    return requests.withColumn("top_k", F.coalesce(F.col("top_k"), F.lit(recommend.DEFAULT_K)))


def _classes(reqs: DataFrame) -> list[tuple[int, DataFrame]]:
    """(k, the requests of at most k and more than k / 2 results) for the powers of two that occur."""
    power = F.ceil(F.log2(F.col("top_k"))).cast("int")
    found = sorted(r.power for r in reqs.select(power.alias("power")).distinct().collect())      # 32 at most
    return [(1 << p, reqs.filter(power == p)) for p in found]


def answer_searches(requests: DataFrame, catalog: DataFrame, image_dim: int) -> DataFrame:
    """(request_id, rank, product_id, title, category, price, score) for a
    batch of search requests; ``catalog`` carries ``vector``."""
    reqs = _with_k(requests).filter(F.col("top_k") > 0)
    classes = _classes(reqs)
    if not classes:
        return reqs.select("request_id", F.lit(None).cast("long").alias("rank"),
                           F.lit(None).cast("string").alias("product_id"),
                           F.lit(None).cast("string").alias("title"),
                           F.lit(None).cast("string").alias("category"),
                           F.lit(None).cast("double").alias("price"),
                           F.lit(None).cast("double").alias("score")).filter(F.lit(False))
    def answer(k: int, some: DataFrame) -> DataFrame:
        hits = recommend.search_text(catalog, some.select(F.col("query").alias("query_text")), k, image_dim=image_dim)
        return (some.join(hits, some.query == hits.query_text, "inner")
                .filter(F.col("rank") <= F.col("top_k"))
                .select("request_id", "rank", "product_id", "title", "category", "price", "score"))
    return reduce(DataFrame.unionByName, [answer(k, some) for k, some in classes])


def answer_recommendations(requests: DataFrame, interactions: DataFrame | None, catalog: DataFrame,
                           image_dim: int, affinity: DataFrame | None = None) -> DataFrame:
    """(request_id, user_id, profile_text, rank, product_id, title, category,
    price, score, message) for a batch of user requests; ``profile_text`` is
    the user's preferred categories joined by spaces. A user without history
    gets one row with ``message`` and no product. With ``affinity`` (counts kept
    by ``streaming.affinity``) the log isn't read."""
    reqs = _with_k(requests).filter(F.col("top_k") > 0)

    def answer(k: int, some: DataFrame) -> DataFrame:
        # only the requested users' interactions, or counts, take part
        users = some.select("user_id").distinct()
        counts = affinity if affinity is not None else recommend.category_affinity(
            interactions.join(users, "user_id", "left_semi"), catalog)
        recs = recommend.recommend_from_affinity(counts.join(users, "user_id", "left_semi"), catalog, k, image_dim=image_dim)
        return some.join(recs, "user_id", "left").filter(F.col("rank").isNull() | (F.col("rank") <= F.col("top_k")))
    answered = reduce(DataFrame.unionByName, [answer(k, some) for k, some in _classes(reqs) or [(recommend.DEFAULT_K, reqs)]])
    return answered.select(
        "request_id", "user_id", "profile_text", "rank", "product_id", "title", "category", "price",
        "score", F.when(F.col("product_id").isNull(), F.lit(NO_HISTORY)).alias("message"))


def _serve(spark: SparkSession, folder: str, schema: T.StructType, answer, out: str,
           checkpoint: str | None, available_now: bool,
           max_files_per_trigger: int | None) -> StreamingQuery:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    requests = reader.json(folder)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # the requests are read several times (largest k, queries, join back)
        batch.persist()
        try:
            with scratch(spark):      # a micro-batch leaves only its answers
                answer(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    w = (requests.writeStream.foreachBatch(per_batch)
         .option("checkpointLocation", checkpoint or scratch_path(spark, "requests-ckpt")))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def serve_searches(spark: SparkSession, folder: str, catalog: DataFrame, image_dim: int, out: str,
                   checkpoint: str | None = None, available_now: bool = False,
                   max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Answer search requests (JSON lines: request_id, query, top_k) arriving
    in ``folder``; answers go to ``out/batch_id=N``."""
    return _serve(spark, folder, SEARCH_REQUEST,
                  lambda b: answer_searches(b, catalog, image_dim), out, checkpoint,
                  available_now, max_files_per_trigger)


def serve_recommendations(spark: SparkSession, folder: str, interactions: DataFrame | None,
                          catalog: DataFrame, image_dim: int, out: str,
                          checkpoint: str | None = None, available_now: bool = False,
                          max_files_per_trigger: int | None = None, affinity_root: str | None = None) -> StreamingQuery:
    """Answer recommendation requests (JSON lines: request_id, user_id,
    top_k) arriving in ``folder``; answers go to ``out/batch_id=N``. With
    ``affinity_root`` each micro-batch reads the counts in force there
    (``streaming.affinity``) in place of the log."""
    def answer(batch: DataFrame) -> DataFrame:
        counts = None if affinity_root is None else read_affinity(spark, affinity_root)
        return answer_recommendations(batch, interactions, catalog, image_dim, counts)
    return _serve(spark, folder, RECOMMEND_REQUEST, answer, out, checkpoint, available_now, max_files_per_trigger)
