"""Explicit schemas of the library's tables. Reads never infer types."""

from pyspark.sql import types as T

# Raw catalogue as it arrives in a CSV file: every field is text, so a bad
# price cannot flip the column type; cleaning casts it.
RAW_PRODUCTS = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("price", T.StringType()),
    T.StructField("rating", T.StringType()),
    T.StructField("num_reviews", T.StringType()),
])

# Served catalogue, in the fixed column order of the products table.
PRODUCTS = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("num_reviews", T.IntegerType()),
])
PRODUCT_COLUMNS = [f.name for f in PRODUCTS.fields]

# Interaction log; ids are text, as in the catalogue.
INTERACTIONS = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("interaction_type", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
])
