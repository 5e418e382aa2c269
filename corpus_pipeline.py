"""Corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark
decontamination, SentencePiece encoding and decoding.

Each stage reads all that its predecessor kept and decides on whole texts.
Filtering stages give every row a key of its own (written once, so that all
readers see the same keys), collect the keys that go in a written table (its
size is known, so Spark broadcasts it when small) and keep the rest by an
anti-join; the documents' own columns, whatever they are, pass through.

Defined results: a decision holds for its row alone, whatever ids are null or
repeated; null texts count as empty (language ``und``: they go in the first
stage); an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import decontaminate, language_id, line_dedup, simhash, unigram_pieces
from vitrine.llm.common import read
from vitrine.session import materialize

#: Language posteriors below this are rejected, as is ``und``.
LEAST_LANGUAGE_SCORE = 0.5
#: So are texts with more bits per byte than this many times what 99 of 100 labelled texts of their
#: language stay below: the posterior tells languages apart, the code length whether it is one at all.
MOST_LANGUAGE_BITS = 3.0
#: Benchmark items of fewer words don't drop a document: a word or two stand in any text.
LEAST_ITEM_WORDS = 4


def _keyed(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` with a key of each row's own, written; the key's name, which no column has."""
    key, taken = "row_key", {c.lower() for c in docs.columns}
    while key in taken:
        key += "_"
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), f"{name}-rows"), key


def _texts(keyed: DataFrame, key: str) -> DataFrame:
    """What the operators read, with the key as id: their results carry it."""
    return keyed.select(F.col(key).alias("doc_id"), "text")


def _without(keyed: DataFrame, key: str, gone: DataFrame, name: str) -> DataFrame:
    keys = materialize(gone.select(F.col("doc_id").alias("gone_key")).distinct(), name)
    return keyed.join(keys, keyed[key] == keys["gone_key"], "left_anti").drop(key)


def _row_hash(docs: DataFrame):
    """A hash of all columns; those of types that Spark doesn't hash count as JSON."""
    plain = [not any(t in f.dataType.simpleString() for t in ("map<", "variant")) for f in docs.schema.fields]
    return F.xxhash64(*[docs[c] if p else F.to_json(F.struct(docs[c])) for c, p in zip(docs.columns, plain)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language (PPM models of this corpus' labelled documents), and those
    that the best model finds far harder to tell than its own language's labelled texts: gibberish and other languages."""
    labelled = docs.filter(~language_id.is_held_out())
    model = language_id.fit(labelled)
    usual = language_id.usual_bits(labelled, model)
    keyed, key = _keyed(docs, "pipeline-language")
    found = language_id.identify(_texts(keyed, key), model)
    odd = F.lit(False)
    for lang, bits in sorted(usual.items()):
        odd = odd | ((F.col("lang_pred") == lang) & (F.col("bits_per_byte") > MOST_LANGUAGE_BITS * bits))
    return _without(keyed, key,
                    found.filter((F.col("lang_pred") == "und") | (F.col("score") < LEAST_LANGUAGE_SCORE) | odd),
                    "pipeline-language")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines of a source out of its texts; every document stays."""
    cleaned = line_dedup.drop_lines(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return cleaned.select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group (3-word shingles, at most 3 bits) one row stays: the smallest id (null
    only where the group has no other), among rows of that id the smallest row hash."""
    keyed, key = _keyed(docs, "pipeline-copies")
    order = keyed.select(F.col(key).alias("key"), F.struct(
        F.col("doc_id").isNull(), F.col("doc_id"), _row_hash(keyed.drop(key)), F.col(key).alias("key")).alias("rank"))
    groups = simhash.near_duplicates(_texts(keyed, key)).select("doc_id", "component_id")
    groups = materialize(groups.join(order, groups["doc_id"] == order["key"]).select("doc_id", "component_id", "rank"),
                         "pipeline-groups")
    stays = groups.groupBy("component_id").agg(F.min("rank")["key"].alias("key")).select("key")
    return _without(keyed, key, groups.join(stays, groups["doc_id"] == stays["key"], "left_anti"), "pipeline-copies")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item of ``LEAST_ITEM_WORDS`` words or more."""
    keyed, key = _keyed(docs, "pipeline-leaks")
    found = decontaminate.leaks(_texts(keyed, key), read(spark, sf_dir, "benchmark"), least_words=LEAST_ITEM_WORDS)
    return _without(keyed, key, found, "pipeline-leaks")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, the text decoded from them, and its checksum and length."""
    return unigram_pieces.round_trip(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("sentencepiece", pieces),
]

#: The stages are not expressible in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
