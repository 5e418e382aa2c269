"""Vector functions and the hashed text embedder."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from vitrine.functions import text, vectors


def test_cosine_distance_edge_cases(spark):
    rows = [(1, [1.0, 0.0], [1.0, 0.0]),     # equal -> 0
            (2, [1.0, 0.0], [-1.0, 0.0]),    # opposite -> 2
            (3, [1.0, 0.0], [0.0, 1.0]),     # orthogonal -> 1
            (4, [0.0, 0.0], [1.0, 0.0]),     # zero vector -> null
            (5, None, [1.0, 0.0])]           # null vector -> null
    df = spark.createDataFrame(rows, "id int, a array<float>, b array<float>")
    got = {r.id: r.d for r in df.select("id", vectors.round6(
        vectors.cosine_distance(F.col("a"), F.col("b"))).alias("d")).collect()}
    assert got == {1: 0.0, 2: 2.0, 3: 1.0, 4: None, 5: None}


def test_self_distance_is_clamped_at_zero(spark):
    v = [0.1, 0.2, 0.3, 0.7, 0.11]
    df = spark.createDataFrame([(v, v)], "a array<float>, b array<float>")
    d = df.select(vectors.cosine_distance(F.col("a"), F.col("b")).alias("d")).first().d
    assert d >= 0.0 and d < 1e-12


def test_unit_vector_and_scores(spark):
    df = spark.createDataFrame([([3.0, 4.0],)], "v array<float>")
    r = vectors.with_unit_vector(df, "v", "u", "n").first()
    assert math.isclose(r.n, 5.0)
    assert np.allclose(r.u, [0.6, 0.8], atol=1e-6)
    s = spark.range(1).select(vectors.score_inverse(F.lit(0.5)).alias("a"),
                              vectors.score_halved(F.lit(0.5)).alias("b")).first()
    assert math.isclose(s.a, 1 / 1.5) and math.isclose(s.b, 0.75)


def test_zero_and_concat(spark):
    r = spark.range(1).select(vectors.concat_vectors(F.array(F.lit(1.0).cast("float")),
                                                     vectors.zero_vector(3)).alias("v")).first()
    assert r.v == [1.0, 0.0, 0.0, 0.0]


def _bucket(word, dim):
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim


def test_hashed_vector_matches_python_rule(spark):
    texts = ["Small Ring ECONOMY", "red-widget  red", "", None, "ünïcode 42 x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: r.v for r in df.select("id", text.hashed_vector(F.col("t"), 16).alias("v")).collect()}
    import re
    for i, t in enumerate(texts):
        want = [0.0] * 16
        for w in re.split("[^a-z0-9]+", (t or "").lower()):
            if w:
                want[_bucket(w, 16)] += 1
        assert got[i] == want, t


def test_product_text(spark):
    df = spark.createDataFrame([("Lamp", "Home"), (None, "Home"), ("Lamp", None)], "t string, c string")
    got = [r.x for r in df.select(text.product_text(F.col("t"), F.col("c")).alias("x")).collect()]
    assert got == ["Lamp Home", " Home", "Lamp "]


def test_no_row_expression_inside_element_lambda(spark):
    """The norm must not be recomputed per element (it would make the
    normalisation quadratic in the dimension)."""
    df = spark.createDataFrame([([1.0, 2.0, 2.0],)], "v array<float>")
    u = vectors.with_unit_vector(df, "v", "u", "n")
    plan = u._jdf.queryExecution().optimizedPlan().toString()
    # the divisor reaches the lambda as a repeated argument
    assert "array_repeat" in plan


def test_empty_texts_and_zero_vectors_do_not_fail(spark):
    """Spark 4 runs with ANSI semantics: no bare division by a zero norm."""
    from vitrine.operators import embed
    df = spark.createDataFrame([(1, "Lamp lamp"), (2, ""), (3, None), (4, "!!")], "id long, t string")
    terms = embed.hashed_terms(df, "id", "t").collect()
    assert {r.id for r in terms} == {1} and [r.weight for r in terms] == [1.0]
    z = spark.createDataFrame([([0.0, 0.0],)], "v array<float>")
    r = vectors.with_unit_vector(z, "v", "u", "n", eps=0.0).first()
    assert r.u == [0.0, 0.0] and r.n == 0.0
