"""The analytics page's interaction counts, kept current over a file stream.

The reference has no streams; its dashboard recomputes the counts per
interaction type from the whole table on every view. Here the same
aggregate (``analytics.interaction_type_counts``) runs as a Structured
Streaming query over new event files: each micro-batch folds its rows into
the running counts, whose state holds one row per interaction type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vitrine.session import scratch_path
from vitrine.sources import versions

# Raw event files as the driver writes them.
EVENT_FILE_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def event_stream(spark: SparkSession, folder: str, glob: str = "events*.parquet",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming event log (event_id, user_id, interaction_type, ts) from
    Parquet files arriving in ``folder``."""
    r = spark.readStream.schema(EVENT_FILE_SCHEMA).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = r.parquet(folder)
    return raw.select("event_id", "user_id", F.col("event_type").alias("interaction_type"), "ts")


def running_type_counts(events: DataFrame) -> DataFrame:
    """Running (interaction_type, count) over a streaming log."""
    return (events.filter(F.col("interaction_type").isNotNull())
            .groupBy("interaction_type").agg(F.count(F.lit(1)).alias("count")))


def start_type_counts(spark: SparkSession, folder: str, table: str | None = None,
                      checkpoint: str | None = None, available_now: bool = True,
                      out: str | None = None) -> StreamingQuery:
    """Start the running counts.

    With ``out`` every micro-batch replaces a versioned table there with the
    complete counts (``sources.versions``: readers of ``read_table`` never see half
    a batch; a replayed batch writes the same table). Without it the counts go to the in-memory table ``table`` (for a
    local dashboard). ``available_now`` processes what is there and stops
    (batch-like refresh); otherwise the query keeps polling. Progress is kept
    in a checkpoint under the shared folder, so a restart resumes.
    """
    if (table is None) == (out is None):
        raise ValueError("give exactly one of table or out")
    ckpt = checkpoint or scratch_path(spark, f"stream-{table or 'type-counts'}")
    w = (running_type_counts(event_stream(spark, folder)).writeStream
         .outputMode("complete").option("checkpointLocation", ckpt))
    if out is not None:
        w = w.foreachBatch(lambda batch, _id: versions.replace_table(batch, out) and None)
    else:
        w = w.format("memory").queryName(table)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
