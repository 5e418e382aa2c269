"""Each user's category counts, kept current over a stream of interaction files.

The reference counts a user's interactions per category from the whole log on
every request. Here Structured Streaming keeps the counts as keyed state (one
row for each user and category): a micro-batch reads its own new files alone,
joins them to the products, and hands on the rows whose count has changed. They
are merged into a versioned table (``sources.versions``), from which requests
read a user's affinity: neither the stream nor a request scans the log again.

Counts are absolute, so a batch that is replayed after a failure merges the same
rows once more and changes nothing; state and progress are in the checkpoint,
and a restarted query goes on from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vitrine.schemas import INTERACTIONS
from vitrine.session import scratch_path
from vitrine.sources import versions

AFFINITY = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("category", T.StringType()),
                         T.StructField("n", T.LongType())])


def merge_counts(changed: DataFrame, root: str) -> None:
    """Puts changed (user_id, category, n) rows into the versioned table under ``root``."""
    spark = changed.sparkSession
    changed = changed.select("user_id", "category", "n")
    if versions.current_version(spark, root) is None:
        versions.replace_table(changed, root)
        return
    old = versions.read_table(spark, root, AFFINITY)
    same = (F.col("o.user_id").eqNullSafe(F.col("c.user_id"))) & (F.col("o.category").eqNullSafe(F.col("c.category")))
    kept = old.alias("o").join(changed.alias("c"), same, "left_anti")
    merged = kept.unionByName(changed)
    # Clustered by user: a request's users skip files.
    versions.replace_table(merged.hint("rebalance", "user_id").sortWithinPartitions("user_id"), root)


def start_affinity(spark: SparkSession, folder: str, products: DataFrame, out: str, checkpoint: str | None = None,
                   available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the counts over Parquet files of interactions that arrive in ``folder``; ``read_affinity`` reads them."""
    reader = spark.readStream.schema(INTERACTIONS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    counts = (reader.parquet(folder).select("user_id", "product_id")
              .join(products.select("product_id", "category"), "product_id")
              .groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("n")))

    def per_batch(batch: DataFrame, _id: int) -> None:
        batch = batch.persist()      # it is read twice
        try:
            merge_counts(batch, out)
        finally:
            batch.unpersist()

    w = (counts.writeStream.outputMode("update").foreachBatch(per_batch)
         .option("checkpointLocation", checkpoint or scratch_path(spark, "affinity-ckpt")))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_affinity(spark: SparkSession, out: str) -> DataFrame:
    """The counts in force (user_id, category, n)."""
    return versions.read_table(spark, out, AFFINITY)
