"""Text vectors with similarity of meaning: latent semantic analysis by a randomised SVD.

Texts are weighted term counts, (1 + ln tf) * ln((1 + N) / (1 + df)) + the same
for every text, so the texts are a sparse matrix A, one row (text, term, weight)
for each entry. Its leading singular vectors place terms that occur in the same
company close to each other, and with them texts that share no word.

The randomised SVD multiplies A and its transpose with a thin block of
``rank + extra`` columns (block power iteration). Each product is a join on the
term (or the text) and a sum, which Spark combines before its shuffle; a term in
a third of all texts costs one partial sum for each task, and AQE splits its
join. The first block is drawn by hashes of the terms, so there is no vocabulary
anywhere but in tables. Blocks are made orthonormal by their Gram matrix
(at the end twice); these matrices of ``rank + extra`` rows are all that reaches
the driver.

The model is a table of terms with their weight and vector. A text's vector is
the weighted sum of its terms' vectors, so new texts (queries) are embedded in
the same way as those it was trained on.

Defined results: texts without a known term get zeros; null texts are empty;
terms of no effect (rank below ``rank``) have zeros in the missing dimensions;
without any term the table is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions.text import tokens
from vitrine.session import materialize, ship_package

RANK = 32
EXTRA = 8        # columns beyond the rank, which make the leading ones exact
ROUNDS = 3       # of the power iteration
SEED = 17


@dataclass
class LsaModel:
    terms: DataFrame          # (term, idf, term_vec)
    singular: np.ndarray      # falling
    rank: int


def term_counts(texts: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, term, tf) of every text."""
    return (texts.select(F.col(key).alias("key"), F.explode(tokens(F.col(text_col))).alias("term"))
            .groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf")))


def _weight() -> Column:
    return (F.lit(1.0) + F.log("tf")) * F.col("idf")


def _names(n: int) -> list[str]:
    return [f"z{i}" for i in range(n)]


def _times(entries: DataFrame, block: DataFrame, shared: str, out: str, n: int) -> DataFrame:
    """The product of the sparse matrix (or its transpose) with a block: rows ``out`` of sums over ``shared``."""
    return (entries.join(block, shared).groupBy(out)
            .agg(*[F.sum(F.col("w") * F.col(z)).alias(z) for z in _names(n)]))


def _block(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return np.stack([batch.column(z).to_numpy(zero_copy_only=False) for z in _names(n)], axis=1).astype(np.float64)


def _gram(block: DataFrame, n: int) -> np.ndarray:
    """Z' Z: partial sums of the tasks, added up in Spark."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            z = _block(batch, n)
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * n)), pa.array(total.ravel())], ["i", "x"])
    g = np.zeros(n * n)
    for r in block.select(*_names(n)).mapInArrow(partial, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        g[r.i] = r.x
    return (g.reshape(n, n) + g.reshape(n, n).T) / 2


def _turned(block: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
    """Each row of a block times a small matrix."""
    n, names = len(matrix), _names(matrix.shape[1])

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _block(batch, n) @ matrix
            yield pa.RecordBatch.from_arrays([batch.column(key), *[pa.array(c) for c in z.T]], [key, *names])
    schema = T.StructType([block.schema[key], *[T.StructField(z, T.DoubleType()) for z in names]])
    return block.select(key, *_names(n)).mapInArrow(turn, schema)


def _orthonormal(block: DataFrame, key: str, n: int, times: int = 1) -> DataFrame:
    """The block with orthonormal columns; directions without extent become zeros."""
    for _ in range(times):      # the second time takes out what rounding left
        block = materialize(block, "lsa-block")
        values, axes = np.linalg.eigh(_gram(block, n))
        keep = values > max(values.max(), 0.0) * 1e-13
        block = _turned(block, key, np.where(keep, axes / np.sqrt(np.where(keep, values, 1.0)), 0.0))
    return block


def fit(texts: DataFrame, key: str, text_col: str, rank: int = RANK, extra: int = EXTRA, rounds: int = ROUNDS) -> LsaModel:
    """Train on all ``texts``; ``key`` tells them apart."""
    ship_package(texts.sparkSession)
    counts = materialize(term_counts(texts, key, text_col), "lsa-counts")
    n_texts = texts.filter(F.col(key).isNotNull()).count()
    idf = (F.log(F.lit(1.0 + n_texts) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf")
    weights = materialize(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", idf), "lsa-idf")
    entries = materialize(counts.join(weights, "term").select("key", "term", _weight().alias("w")), "lsa-entries")
    n = rank + extra
    # Random signs of the terms, drawn by hash: any number of them, the same for any partitions.
    block = weights.select("term", *[
        (F.lit(1.0) - 2.0 * F.pmod(F.xxhash64("term", F.lit(SEED * 1000 + i)), F.lit(2)).cast("double")).alias(z)
        for i, z in enumerate(_names(n))])
    rows = _orthonormal(_times(entries, block, "term", "key", n), "key", n)
    for i in range(rounds):
        block = _orthonormal(_times(entries, rows, "key", "term", n), "term", n)
        rows = _orthonormal(_times(entries, block, "term", "key", n), "key", n, 2 if i == rounds - 1 else 1)
    # A is about Q (Q' A); the small factor's singular vectors turn Q' A into the terms' vectors.
    small = materialize(_times(entries, rows, "key", "term", n), "lsa-block")
    values, axes = np.linalg.eigh(_gram(small, n))
    values, axes = np.maximum(values[::-1][:rank], 0.0), axes[:, ::-1][:, :rank]
    keep = values > max(values.max(initial=0.0), 0.0) * 1e-12
    turned = _turned(small, "term", np.where(keep, axes / np.sqrt(np.where(keep, values, 1.0)), 0.0))
    vectors = turned.join(weights, "term").select("term", "idf", F.array(*_names(rank)).alias("term_vec"))
    return LsaModel(materialize(vectors, "lsa-terms"), np.sqrt(np.where(keep, values, 0.0)), rank)


def embed(texts: DataFrame, key: str, text_col: str, model: LsaModel, out: str = "lsa_vec") -> DataFrame:
    """(key, vector) of every distinct key of ``texts``: the weighted sum of its terms' vectors."""
    names = [f"z{i}" for i in range(model.rank)]
    known = term_counts(texts, key, text_col).join(model.terms, "term").withColumn("w", _weight())
    sums = known.groupBy("key").agg(*[F.sum(F.col("w") * F.col("term_vec")[i]).alias(z) for i, z in enumerate(names)])
    keys = texts.select(F.col(key).alias("key")).distinct()
    vec = F.array(*[F.coalesce(F.col(z), F.lit(0.0)) for z in names])
    return (keys.join(sums.withColumnRenamed("key", "of_key"), F.col("key").eqNullSafe(F.col("of_key")), "left")
            .select(F.col("key").alias(key), vec.alias(out)))
