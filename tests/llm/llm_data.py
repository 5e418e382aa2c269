"""Small tables for the tests of the training-data operators."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(40_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or return: an input may have them too.
CLASHING = ("fp", "node", "component_id", "kept", "keep_id", "b_host", "b_lines", "hash", "line", "part", "n_words",
            "score", "gone_id", "body", "start", "key", "mask")


def rows():
    """Nulls in every column, empty, blank, very long and repeated texts, repeated rows."""
    return [
        (1, "Hello world this is a test", "en", "a", 26), (2, "Hello world this is a test", "en", "a", 26),
        (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \t\n ", "en", None, 4), (6, LONG, "en", "a", len(LONG)),
        (7, "Ünïcode — ça va ▁ marker 東京 \U0001f600\nline two", "fr", "b", None), (8, LONG + " end", "en", "a", None),
        (9, "a", "en", "b", 1), (9, "a", "en", "b", 1), (None, "orphan text", "en", "b", 11), (10, "12 34 !!", "de", "b", 8),
        (11, "\x00\x0b\x1c odd \x85 spaces here", "en", "a", None),
    ]


def frame(spark, data=None, clash: bool = True):
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA)
    if clash:
        from pyspark.sql import functions as F
        df = df.withColumns({c: F.lit("extra") for c in CLASHING})
    return df


def sample(table: str = "documents", sf: str = SF) -> list[dict]:
    import pyarrow.parquet as pq
    return pq.read_table(f"{sf}/{table}.parquet").to_pylist()
