"""Line deduplication by site-relative frequency.

Per host, a line's share is the number of the host's pages that hold it over
all pages of the host. A line of a page is dropped when its share exceeds
``ratio`` and at least ``min_pages`` pages of the host hold it; the rest of the
page is joined again. DataFrame functions only.

Scale: lines are counted by (host, 64-bit hash), pre-aggregated in each task,
so no text is shuffled for the count; the few hashes above the ratio are then
recounted by the line's own text, which makes the result exact whatever the
hash does. A host has at most (mean distinct lines per page) / ratio such
lines, whatever its number of pages: that list is joined to the pages by host.
Being a written table its size is known, so Spark broadcasts it when small
and otherwise shuffles, with AQE splitting a hot host.

Defined results: a null text has no lines and stays null; a null host is a
host of its own; a line counts once per page however often it stands there;
lines that are empty or white space are layout: they are never counted or
dropped; rows that repeat are pages of their own; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import read
from vitrine.session import materialize

RATIO = 0.05
MIN_PAGES = 3


def _lines(docs: DataFrame, host: str, text: str) -> DataFrame:
    """(host, line): every distinct non-blank line of every page."""
    return (docs.select(F.col(host).alias("host"), F.explode(F.array_distinct(F.split(text, "\n", -1))).alias("line"))
            .filter(F.col("line").rlike(r"\S")))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line, n_pages, host_pages) of the lines above the ratio."""
    totals = docs.groupBy(F.col(host).alias("total_host")).agg(F.count(F.lit(1)).alias("host_pages"))
    above = (F.col("n_pages") >= min_pages) & (F.col("n_pages") > F.col("host_pages") * F.lit(ratio))

    def over(counts: DataFrame) -> DataFrame:
        return counts.join(totals, F.col("host").eqNullSafe(F.col("total_host"))).filter(above)

    lines = _lines(docs, host, text).withColumn("hash", F.xxhash64("line"))
    hashed = lines.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    suspects = materialize(over(hashed).select(F.col("host").alias("s_host"), F.col("hash").alias("s_hash")),
                           "line-suspects")
    exact = (lines.join(suspects, F.col("hash").eqNullSafe(F.col("s_hash"))
                        & F.col("host").eqNullSafe(F.col("s_host")), "left_semi")
             .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_pages")))
    return over(exact).select("host", "line", "n_pages", "host_pages")


def drop_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
               min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with two columns more: ``kept_text`` and ``n_dropped``."""
    lists = materialize(boilerplate(docs, host, text, ratio, min_pages).groupBy(F.col("host").alias("b_host"))
                        .agg(F.array_sort(F.collect_list("line")).alias("b_lines")), "line-boilerplate")
    joined = docs.join(lists, docs[host].eqNullSafe(lists.b_host), "left")
    lines = F.split(docs[text], "\n", -1)
    kept = F.filter(lines, lambda line: ~F.array_contains(lists.b_lines, line))
    return joined.select(
        *[docs[c] for c in docs.columns],
        F.when(lists.b_lines.isNull(), docs[text]).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.when(lists.b_lines.isNull() | docs[text].isNull(), 0).otherwise(F.size(lines) - F.size(kept))
        .cast("long").alias("n_dropped"))


def query(spark, sf_dir: str) -> DataFrame:
    """All documents without the lines that over a twentieth of their source's documents share."""
    return drop_lines(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        "doc_id", "source", "n_dropped", F.col("kept_text").alias("text"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (SELECT rid, source, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS place FROM d WHERE text IS NOT NULL),
totals AS (SELECT source, count(*) AS host_pages FROM d GROUP BY source),
counts AS (SELECT source, line, count(DISTINCT rid) AS n_pages FROM l
           WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]') GROUP BY source, line),
bad AS (SELECT c.source, c.line FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
        WHERE n_pages >= 3 AND n_pages > host_pages * 0.05),
marked AS (SELECT l.rid, l.place, l.line, b.line IS NOT NULL AS dropped
           FROM l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line),
kept AS (SELECT rid, count(*) FILTER (dropped) AS n_dropped,
                coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '') AS text FROM marked GROUP BY rid)
SELECT d.doc_id, d.source, coalesce(k.n_dropped, 0) AS n_dropped, k.text
FROM d LEFT JOIN kept k USING (rid)
"""
