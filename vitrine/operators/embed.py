"""Product and query vectors.

A product vector is ``[text part, image part]``: the text part embeds
``"{title} {category}"``, the image part comes from an image-vector table
(left join on product id) and is zeros where a product has none. A text
query gets the same text embedding and a zero image part.

The default text embedder is the hashed bag of words of
``functions.text.hashed_vector`` (JVM expressions, no shuffle). A caller may
plug in a model instead: ``model_vectors`` runs a batch function inside
``mapInPandas``; the model is built once per Python worker and fed whole
Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions.text import TEXT_DIM, hashed_vector, product_text, token_buckets
from vitrine.functions.vectors import concat_vectors, vector_fault, zero_vector
from vitrine.session import ship_package

FLOAT_VECTOR = T.ArrayType(T.FloatType())


def text_vectors(df: DataFrame, text_col: str, out: str = "text_vec",
                 dim: int = TEXT_DIM) -> DataFrame:
    """Add the hashed text vector of ``text_col``."""
    return df.withColumn(out, hashed_vector(F.col(text_col), dim))


def hashed_terms(df: DataFrame, key: str, text_col: str, dim: int = TEXT_DIM) -> DataFrame:
    """Sparse long form of the hashed vector: (key, bucket, weight) with
    weight the unit-normalised count, non-zero buckets only.

    Tokens are hashed once and counted by (key, bucket) without a dense
    vector; a key's length is the sum over its at most ``dim`` buckets. Keys
    are unique (one text each)."""
    terms = (df.select(key, F.explode(token_buckets(F.col(text_col), dim)).alias("bucket"))
             .groupBy(key, "bucket").agg(F.count(F.lit(1)).cast("double").alias("n")))
    squares = F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key))
    return (terms.withColumn("norm", F.sqrt(squares))
            .select(key, F.col("bucket").cast("long").alias("bucket"), F.round(F.col("n") / F.col("norm"), 6).alias("weight")))


def vector_rejects(vectors: DataFrame, id_col: str, vec_col: str, dim: int, zero_ok: bool = False) -> DataFrame:
    """(id, reason) of the vectors that cannot take part (``functions.vectors.vector_fault``)."""
    fault = vector_fault(F.col(vec_col), dim, zero_ok)
    return vectors.select(F.col(id_col), fault.alias("reason")).filter(F.col("reason").isNotNull())


def product_vectors(products: DataFrame, images: DataFrame | None, image_dim: int,
                    text_dim: int = TEXT_DIM) -> DataFrame:
    """Products with ``text`` , ``text_vec``, ``image_vec`` and ``vector``
    (= text part then image part).

    ``images`` holds (product_id, image_vec), one row per product id (a
    picture file is named by its product id); it is left-joined, so every
    product keeps its row and one without a valid image vector of the declared
    length gets zeros. ``vector_rejects`` lists the images that were set aside.

    Text rows are small and their vectors costly: the rows are dealt by id first,
    to a number of tasks of its own (which AQE doesn't lower by their bytes), so the
    join finds them in place, and vectors are computed after it and never shuffled.
    """
    tasks = int(products.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = (products.withColumn("text", product_text(F.col("title"), F.col("category")))
            .repartition(tasks, "product_id"))
    if images is not None:
        good = images.filter(vector_fault(F.col("image_vec"), image_dim, zero_ok=True).isNull())
        base = base.join(good.select("product_id", "image_vec"), "product_id", "left")
    else:
        base = base.withColumn("image_vec", F.lit(None).cast(FLOAT_VECTOR))
    base = text_vectors(base, "text", "text_vec", text_dim).withColumn(
        "image_vec",
        F.when(F.col("image_vec").isNull(), zero_vector(image_dim))
         .otherwise(F.col("image_vec").cast(FLOAT_VECTOR)))
    return base.withColumn("vector", concat_vectors(F.col("text_vec"), F.col("image_vec")))


def query_vectors(queries: DataFrame, text_col: str, image_dim: int,
                  text_dim: int = TEXT_DIM) -> DataFrame:
    """Queries with ``vector`` = hashed text, then ``image_dim`` zeros."""
    q = text_vectors(queries, text_col, "text_vec", text_dim)
    return q.withColumn("vector", concat_vectors(F.col("text_vec"), zero_vector(image_dim)))


# Encoders built in this Python worker, by factory. Python workers are reused
# across tasks, so a model is loaded once per worker, not once per task.
_ENCODERS: dict[str, Callable] = {}


def _factory_key(make_encoder: Callable) -> str:
    """Stable key of a factory, computed on the driver from its pickle."""
    from pyspark import cloudpickle
    return hashlib.sha1(cloudpickle.dumps(make_encoder)).hexdigest()


def _encoder(key: str, make_encoder: Callable) -> Callable:
    enc = _ENCODERS.get(key)
    if enc is None:
        enc = _ENCODERS[key] = make_encoder()
    return enc


def model_vectors(df: DataFrame, text_col: str, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
                  dim: int, out: str = "text_vec", error_col: str = "embed_error") -> DataFrame:
    """Vectors from a caller's model, batched through Arrow.

    ``make_encoder()`` is called once per Python worker and returns a
    function mapping a list of texts to an (n, dim) array. A batch the model
    rejects is retried row by row; a row that still fails gets a null vector
    and the error text in ``error_col`` (the job goes on, as the reference
    skips rows it cannot embed), so callers can set such rows aside.
    """
    ship_package(df.sparkSession)
    schema = T.StructType(df.schema.fields + [T.StructField(out, FLOAT_VECTOR),
                                              T.StructField(error_col, T.StringType())])
    key = _factory_key(make_encoder)

    def encode_one(enc, text):
        try:
            return np.asarray(enc([text]), dtype=np.float32).reshape(dim), None
        except Exception as exc:  # noqa: BLE001 - the row is set aside with the reason
            return None, f"{type(exc).__name__}: {exc}"

    def run(batches):
        enc = _encoder(key, make_encoder)
        for pdf in batches:
            texts = pdf[text_col].fillna("").astype(str).tolist()
            try:
                mat = np.asarray(enc(texts), dtype=np.float32).reshape(len(texts), dim)
                vecs, errors = list(mat), [None] * len(texts)
            except Exception:  # noqa: BLE001 - retry the batch row by row
                pairs = [encode_one(enc, t) for t in texts]
                vecs, errors = [p[0] for p in pairs], [p[1] for p in pairs]
            pdf[out] = vecs
            pdf[error_col] = errors
            yield pdf

    return df.mapInPandas(run, schema)


def image_file_vectors(files: DataFrame, make_encoder: Callable[[], Callable[[list[bytes]], np.ndarray]],
                       dim: int) -> DataFrame:
    """(product_id, image_vec, embed_error) from a ``binaryFile`` scan of ``{id}.jpg``.

    The encoder gets the pictures of a batch at once; a batch it rejects is
    retried picture by picture. A file it cannot read gets zeros, as in the
    reference, and the error's text; the others' error is null.
    """
    named = files.select(
        F.regexp_extract("path", r"([^/]+)\.[A-Za-z0-9]+$", 1).alias("product_id"), "content")
    ship_package(files.sparkSession)
    schema = T.StructType([T.StructField("product_id", T.StringType()),
                           T.StructField("image_vec", FLOAT_VECTOR),
                           T.StructField("embed_error", T.StringType())])
    key = _factory_key(make_encoder)

    def run(batches):
        enc = _encoder(key, make_encoder)
        for pdf in batches:
            blobs = [bytes(b) for b in pdf["content"]]
            errors: list[str | None] = [None] * len(blobs)
            try:
                vecs = list(np.asarray(enc(blobs), dtype=np.float32).reshape(len(blobs), dim))
            except Exception:  # noqa: BLE001 - retry the batch picture by picture
                vecs = []
                for i, blob in enumerate(blobs):
                    try:
                        vecs.append(np.asarray(enc([blob]), dtype=np.float32).reshape(dim))
                    except Exception as exc:  # noqa: BLE001 - zeros, with the reason
                        vecs.append(np.zeros(dim, dtype=np.float32))
                        errors[i] = f"{type(exc).__name__}: {exc}"
            yield pd.DataFrame({"product_id": pdf["product_id"], "image_vec": vecs, "embed_error": errors})

    return named.mapInPandas(run, schema)


__all__ = ["text_vectors", "hashed_terms", "product_vectors", "query_vectors",
           "model_vectors", "image_file_vectors", "token_buckets"]
