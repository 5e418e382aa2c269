"""Text column functions: product text, tokens, hashed bag-of-words vectors.

The hashed vector is the library's default text embedder: each lower-cased
alphanumeric token is hashed (first 32 bits of its MD5, modulo ``dim``) and
the vector holds the token count per bucket. It runs as plain JVM
expressions per row, so embedding a catalogue needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the dimension of the reference's text vectors.
TEXT_DIM = 384
TOKEN_SPLIT = "[^a-z0-9]+"


def product_text(title: Column, category: Column) -> Column:
    """``"{title} {category}"``; a missing part is an empty string."""
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(category, F.lit("")))


def tokens(text: Column) -> Column:
    """Lower-cased alphanumeric tokens, empty pieces removed."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_SPLIT), lambda w: w != "")


def token_bucket(word: Column, dim: int = TEXT_DIM) -> Column:
    """Bucket of one token: first 8 hex digits of its MD5, modulo ``dim``."""
    h = F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long")
    return F.pmod(h, F.lit(dim))


def token_buckets(text: Column, dim: int = TEXT_DIM) -> Column:
    """Array of bucket numbers, one per token."""
    return F.transform(tokens(text), lambda w: token_bucket(w, dim))


def hashed_vector(text: Column, dim: int = TEXT_DIM) -> Column:
    """Dense ``array<float>`` of token counts per bucket.

    The counts are first gathered in a small map (one entry per distinct
    bucket of the text), then read once per dimension; the map reaches the
    per-dimension lambda as a repeated argument, so it is built once per
    row. The buckets enter as the argument of an outer lambda: a bound value,
    so every token is hashed once, however long the text is.
    """
    def counted(buckets: Column) -> Column:
        return F.map_from_entries(F.transform(
            F.array_distinct(buckets),
            lambda b: F.struct(b.alias("k"), F.size(F.filter(buckets, lambda x: x == b)).cast("float").alias("v"))))

    counts = F.element_at(F.transform(F.array(token_buckets(text, dim)), counted), 1)
    dims = F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long"))
    return F.zip_with(dims, F.array_repeat(counts, F.lit(dim)),
                      lambda i, m: F.coalesce(F.element_at(m, i), F.lit(0.0).cast("float")))
