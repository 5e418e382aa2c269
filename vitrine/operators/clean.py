"""Catalogue cleaning: missing fields, price coercion, title dedup, rejects.

A raw catalogue row is kept when id, title, category and price are present (a
CSV missing-value token counts as absent), the price parses as a number that
is not NaN and is greater than zero, and it is the lowest product id among
the rows that share its title. Every other row is set aside in a rejects
table with its reason, exact copies included, so rows read = rows kept + rows
set aside; an audit row counts each stage. A catalogue without a category or
price column takes the default (``DEFAULTS``) in every row, and no row is set
aside for it. Ids are text; with ``id_type`` they
are cast, and what the type can't hold is a reject, never a silent null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions.cleaning import missing_as_null, parse_number, valid_price
from vitrine.schemas import PRODUCTS

REQUIRED = ("title", "category", "price")
# What rows have whose catalogue lacks the column.
DEFAULTS = {"category": "", "price": 0.0}

# Reject reasons, in the order the checks run.
MISSING_ID = "missing_id"
MISSING_FIELD = "missing_field"
BAD_PRICE = "bad_price"
NON_POSITIVE_PRICE = "non_positive_price"
DUPLICATE_TITLE = "duplicate_title"


def _typed(raw: DataFrame, id_type: str | None) -> DataFrame:
    """Null out missing tokens in text fields and type the numeric ones
    (one projection)."""
    types = dict((f.name, f.dataType) for f in raw.schema.fields)
    is_text = {n: isinstance(t, T.StringType) for n, t in types.items()}
    cols = []
    for name in raw.columns:
        c = missing_as_null(F.col(name)) if is_text[name] else F.col(name)
        if name in ("rating", "num_reviews") and is_text[name]:
            c = parse_number(F.col(name), "double" if name == "rating" else "int")
        elif name == "product_id" and id_type is not None:
            c = c.try_cast(id_type)
        cols.append(c.alias(name))
    price = parse_number(F.col("price"), "double") if is_text["price"] else F.col("price")
    cols.append(F.col("price").cast("string").alias("price_text"))
    cols.append(price.cast("double").alias("price_value"))
    return raw.select(*cols)


def classify(raw: DataFrame, id_type: str | None = None) -> DataFrame:
    """Raw rows plus ``price_value`` and ``reason`` (null for a valid row,
    before dedup)."""
    absent = [name for name in DEFAULTS if name not in raw.columns]
    typed = _typed(raw.withColumns({name: F.lit(DEFAULTS[name]) for name in absent}), id_type)
    typed = typed.withColumns({name: F.lit(DEFAULTS[name]) for name in absent})      # an empty text isn't a missing one here
    present = F.lit(True)
    for name in REQUIRED:
        present = present & F.col(name).isNotNull()
    pv = F.col("price_value")
    reason = F.when(F.col("product_id").isNull(), F.lit(MISSING_ID)).when(~present, F.lit(MISSING_FIELD))
    if "price" not in absent:
        reason = reason.when(pv.isNull() | F.isnan(pv), F.lit(BAD_PRICE)).when(~valid_price(pv), F.lit(NON_POSITIVE_PRICE))
    return typed.withColumn("reason", reason)


def _products_shape(df: DataFrame) -> DataFrame:
    cols = []
    for field in PRODUCTS.fields:
        name, dtype = field.name, field.dataType
        if name == "price":
            cols.append(F.col("price_value").cast(dtype).alias("price"))
        elif name == "product_id":      # text, or the type the caller asked for
            cols.append(F.col(name))
        elif name in df.columns:
            cols.append(F.col(name).cast(dtype).alias(name))
        else:  # absent input column -> typed default
            cols.append(F.lit(None).cast(dtype).alias(name))
    return df.select(*cols)


def dedup_titles(valid: DataFrame) -> DataFrame:
    """One row per title: the row with the lowest product id.

    Written as an aggregate of ``min(struct(product_id, ...))`` so the choice
    is deterministic and Spark combines map-side before the shuffle; a title
    held by a third of all rows costs one row per map task.
    """
    rest = [c for c in ("price_text",) if c in valid.columns]      # the same order as the rejects'
    rest += [c for c in valid.columns if c not in ("title", "product_id", "price_text")]
    kept = valid.groupBy("title").agg(
        F.min(F.struct("product_id", *rest)).alias("r"),
        F.count(F.lit(1)).alias("n_copies"))
    return kept.select("title", "r.*", "n_copies")


def clean_products(raw: DataFrame, id_type: str | None = None) -> DataFrame:
    """Cleaned catalogue in the fixed 8-column order."""
    c = classify(raw, id_type)
    valid = c.filter(F.col("reason").isNull()).drop("reason")
    return _products_shape(dedup_titles(valid))


def clean_rejects(raw: DataFrame, id_type: str | None = None) -> DataFrame:
    """Rows set aside: product_id, title, raw price text, reason."""
    c = classify(raw, id_type)
    invalid = c.filter(F.col("reason").isNotNull()).select(
        "product_id", "title", "price_text", "reason")
    valid = c.filter(F.col("reason").isNull())
    # Equal rows are counted first (combined map-side), so that exact copies
    # are one row with a number; the kept row of a title gives up one of its
    # copies, every other row all of them. AQE splits a hot title's join.
    counted = valid.groupBy("title", "product_id", "price_text").agg(F.count(F.lit(1)).alias("n"))
    first = counted.groupBy("title").agg(F.min(F.struct("product_id", "price_text")).alias("kept"))
    dups = (counted.join(first, "title")
            .withColumn("left", F.col("n") - F.when(F.struct("product_id", "price_text") == F.col("kept"), 1).otherwise(0))
            .filter("left > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("left"))))
            .select("product_id", "title", "price_text", F.lit(DUPLICATE_TITLE).alias("reason")))
    return invalid.unionByName(dups)


def clean_audit(raw: DataFrame, id_type: str | None = None) -> DataFrame:
    """One row of counts: read, dropped per reason, duplicates, kept."""
    c = classify(raw, id_type)
    r = F.col("reason")
    valid = r.isNull()
    return c.agg(
        F.count(F.lit(1)).alias("n_read"),
        F.count_if(r == MISSING_ID).alias("n_missing_id"),
        F.count_if(r == MISSING_FIELD).alias("n_missing_field"),
        F.count_if(r == BAD_PRICE).alias("n_bad_price"),
        F.count_if(r == NON_POSITIVE_PRICE).alias("n_non_positive_price"),
        F.count_if(valid).alias("n_valid"),
        F.count_distinct(F.when(valid, F.col("title"))).alias("n_clean"),
    ).withColumn("n_duplicate_title", F.col("n_valid") - F.col("n_clean"))
