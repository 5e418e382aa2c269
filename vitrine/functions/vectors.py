"""Vector column functions, all JVM-side (higher-order array functions).

Vectors are ``array<float>`` columns. Arithmetic is done in double. No
per-element lambda refers to a row-level expression (such as a norm): the
optimizer may inline it there and recompute it for every element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8  # added to the norm before dividing, as in the reference's query path


def zero_vector(dim: int) -> Column:
    """``dim`` zeros as ``array<float>``."""
    return F.array_repeat(F.lit(0.0).cast("float"), F.lit(dim))


def concat_vectors(*cols: Column) -> Column:
    """Concatenate vectors in the order given (text part first)."""
    return F.concat(*cols)


def dot(a: Column, b: Column) -> Column:
    """Sum of element-wise products, in double."""
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, v: acc + v)


def l2_norm(a: Column) -> Column:
    """Euclidean length, in double."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def scale(a: Column, norm: Column, eps: float = EPS, as_float: bool = True) -> Column:
    """``a / (norm + eps)`` element-wise, as ``array<float>`` (storage) or
    ``array<double>``.

    The divisor enters as a repeated argument, not as a reference inside
    the lambda: the optimizer inlines projected columns, and a norm inlined
    into a per-element lambda would be recomputed for every element.
    """
    def one(x, n):
        d = n + F.lit(eps)
        # a zero vector (possible when eps is 0) stays zeros; under ANSI
        # semantics a bare 0/0 would fail the job
        v = F.when(d == 0, F.lit(0.0)).otherwise(x.cast("double") / d)
        return v.cast("float") if as_float else v
    return F.zip_with(a, F.array_repeat(norm, F.size(a)), one)


def with_unit_vector(df: DataFrame, vec: str, out: str = "unit_vec", norm_out: str = "norm",
                     eps: float = EPS, as_float: bool = True) -> DataFrame:
    """Add the L2 norm and the normalised vector ``v / (|v| + eps)``."""
    return (df.withColumn(norm_out, l2_norm(F.col(vec)))
              .withColumn(out, scale(F.col(vec), F.col(norm_out), eps, as_float)))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None,
                    norm_b: Column | None = None) -> Column:
    """``1 - a.b / (|a| |b|)``, floored at 0; null when either norm is 0."""
    na = norm_a if norm_a is not None else l2_norm(a)
    nb = norm_b if norm_b is not None else l2_norm(b)
    d = F.lit(1.0) - dot(a, b) / (na * nb)
    return F.when((na > 0) & (nb > 0), F.greatest(d, F.lit(0.0)))


def score_inverse(distance: Column) -> Column:
    """Score of the search API: ``1 / (1 + d)``."""
    return F.lit(1.0) / (F.lit(1.0) + distance)


def score_halved(distance: Column) -> Column:
    """Score of the search page: ``1 - d / 2``."""
    return F.lit(1.0) - distance / F.lit(2.0)


def round6(c: Column) -> Column:
    """Distances and scores are compared and ranked at 6 decimals."""
    return F.round(c, 6)


def vector_fault(v: Column, dim: int | Column, zero_ok: bool = False) -> Column:
    """Why a vector cannot take part, or null: the one definition of a valid
    vector (of the declared length, no null, NaN or infinite entry, and not
    all zeros unless ``zero_ok``)."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fault = (F.when(v.isNull(), F.lit("missing_vector"))
             .when(F.size(v) != dim, F.lit("wrong_length"))
             .when(odd, F.lit("not_finite")))
    return fault if zero_ok else fault.when(~F.exists(v, lambda x: x != 0), F.lit("zero_vector"))
