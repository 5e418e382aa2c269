"""Adapters from the driver's test tables to the library's data model.

The adapters only rename and retype columns, render keys as text ids and, for
the raw catalogue, fields as text; they do none of the work of the operators
that read them. Column pruning reaches the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.schemas import PRODUCT_COLUMNS


# Fixed value: the declared length of the stand-in image vectors.
IMAGE_DIM = 64

# The layouts of the driver's tables. Reading with a declared
# schema skips the footer-inference job and pins the types.
TABLE_SCHEMAS = {
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
              "props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in TABLE_SCHEMAS:
        reader = reader.schema(TABLE_SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _text_key(letter: str, key: Column) -> Column:
    """A letter and the number with at least five places; a null key stays null, longer numbers keep all digits."""
    digits = key.cast("string")
    padded = (F.when(F.length(digits) >= 5, digits)
              .when(key < 0, F.concat(F.lit("-"), F.lpad(F.substring(digits, 2, 4), 4, "0")))
              .otherwise(F.lpad(digits, 5, "0")))
    return F.concat(F.lit(letter), padded)


def product_key(key: Column) -> Column:
    """Text product id, ``P00001`` and so on."""
    return _text_key("P", key)


def user_key(key: Column) -> Column:
    """Text user id, ``U00001`` and so on."""
    return _text_key("U", key)


def part_title() -> Column:
    """A part's title: name, brand and size (names alone repeat every 64 parts)."""
    return F.concat_ws(" ", "p_name", "p_brand", F.col("p_size").cast("string"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue from ``part``: id, title, category, brand, price.

    Description, rating and review count do not exist there and are typed
    nulls (absent input columns take their default, see ``sources.files``).
    """
    part = read_table(spark, sf_dir, "part")
    return part.select(
        product_key(F.col("p_partkey")).alias("product_id"),
        part_title().alias("title"),
        F.lit(None).cast("string").alias("description"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").cast("double").alias("price"),
        F.lit(None).cast("double").alias("rating"),
        F.lit(None).cast("int").alias("num_reviews"),
    ).select(*PRODUCT_COLUMNS)


# Fixed set of dirty field values used to stand in for a messy CSV export.
# They are the CSV trap cases of the cleaning step (missing tokens, numbers
# that only some parsers accept, non-positive prices).
DIRTY_TITLES = [None, "", "NA", "null", "None"]
DIRTY_PRICES = ["", "NA", "x", "NaN", "1d", " 12 ", "inf", "1e2", "1,000",
                "0x10", "1_0", "-5", "0"]


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``part`` rendered as raw text rows of a product export.

    Every row keeps its fields; one row in 40 gets a dirty title, one in 20 a
    dirty price and one in 50 a missing id, chosen by key so that any engine
    reading the same table sees the same strings; one row in 100 comes twice.
    The cleaning operators make no use of this rule: they see only strings.
    """
    part = read_table(spark, sf_dir, "part")
    part = part.unionByName(part.filter(F.pmod("p_partkey", F.lit(100)) == 0))
    key = F.col("p_partkey")
    titles = F.array(*[F.lit(v).cast("string") for v in DIRTY_TITLES])
    prices = F.array(*[F.lit(v) for v in DIRTY_PRICES])
    title = (F.when(F.pmod(key, F.lit(40)) == 3,
                    F.element_at(titles, (F.pmod(F.floor(key / 40), F.lit(len(DIRTY_TITLES))) + 1).cast("int")))
             .otherwise(part_title()))
    price = (F.when(F.pmod(key, F.lit(20)) == 7,
                    F.element_at(prices, (F.pmod(F.floor(key / 20), F.lit(len(DIRTY_PRICES))) + 1).cast("int")))
             .otherwise(F.col("p_retailprice").cast("string")))
    return part.select(
        F.when(F.pmod(key, F.lit(50)) == 9, F.lit("NA")).otherwise(product_key(key)).alias("product_id"),
        title.alias("title"),
        F.lit(None).cast("string").alias("description"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        price.alias("price"),
        F.lit(None).cast("string").alias("rating"),
        F.lit(None).cast("string").alias("num_reviews"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interaction log from ``lineitem`` joined to ``orders``.

    Each order line is one purchase of a product (``l_partkey``) by the
    order's customer at the order date. The join is on the order key, a
    large equi-join that Spark plans as a sort-merge (or broadcast when AQE
    sees a small side).
    """
    line = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey, "inner")
    return joined.select(
        user_key(F.col("o_custkey")).alias("user_id"),
        product_key(F.col("l_partkey")).alias("product_id"),
        F.lit("purchase").alias("interaction_type"),
        F.col("o_orderdate").cast(T.TimestampNTZType()).alias("ts"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed activity log from ``events`` (view, click, purchase, ...)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").cast("long").alias("event_id"),
        user_key(F.col("user_id")).alias("user_id"),
        F.col("event_type").alias("interaction_type"),
        F.col("ts").cast(T.TimestampNTZType()).alias("ts"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled vectors from ``embeddings``; the label is the category."""
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding"),
        F.col("label").cast("int").alias("label"),
    )


def image_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image vectors keyed by product id, read from ``embeddings``.

    The driver tables hold no pictures; the vector table stands in for the
    output of an image encoder, one vector per product id that has one.
    """
    return vectors(spark, sf_dir).select(
        product_key(F.col("vec_id")).alias("product_id"), F.col("embedding").alias("image_vec"))


def faulty_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector) from ``embeddings`` with one row in ten made unusable: null, too
    short, a null entry, a NaN entry, all zeros (by key, for any engine alike)."""
    v, key = F.col("embedding"), F.pmod("vec_id", F.lit(50))
    short = F.slice(v, 1, IMAGE_DIM - 1)

    def ending(x):
        return F.concat(short, F.array(F.lit(x).cast("float")))
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("id"),
        F.when(key == 1, F.lit(None)).when(key == 2, short).when(key == 3, ending(None))
        .when(key == 4, ending(float("nan"))).when(key == 5, F.transform(v, lambda x: F.lit(0.0).cast("float")))
        .otherwise(v).alias("vector"))


def awkward_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_id, title, brand, price) from ``part`` with titles that a CSV file has to quote."""
    name, key = F.col("p_name"), F.pmod("p_partkey", F.lit(7))
    title = (F.when(key == 0, F.concat(F.lit('say "hi", '), name)).when(key == 1, F.concat(name, F.lit("\nsecond line")))
             .when(key == 2, F.lit("")).when(key == 3, F.lit(None)).when(key == 4, F.concat(F.lit(" "), name, F.lit(" ")))
             .when(key == 5, F.lit('"')).otherwise(name))
    return read_table(spark, sf_dir, "part").select(
        product_key(F.col("p_partkey")).alias("product_id"), title.alias("title"),
        F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, content) from ``embeddings``: a picture header for each vector, of a format and size that follow its key,
    and a body of digits; some are cut off, empty or something else."""
    key, kind = F.col("vec_id"), F.pmod("vec_id", F.lit(8))
    width, height = F.pmod("vec_id", F.lit(1000)) + 1, F.pmod(F.col("vec_id") * 7, F.lit(900)) + 1

    def big(x: Column, n: int) -> Column:
        return F.lpad(F.hex(x), 2 * n, "0")

    def little(x: Column) -> Column:
        return F.concat(F.substring(big(x, 2), 3, 2), F.substring(big(x, 2), 1, 2))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(width, 4), big(height, 4), F.lit("0802000000"))
    gif = F.concat(F.lit("474946383961"), little(width), little(height))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC0001108"), big(height, 2), big(width, 2), F.lit("03"))
    head = (F.when(kind <= 2, png).when(kind == 3, gif).when(kind == 4, jpeg).when(kind == 5, F.substring(png, 1, 36))
            .when(kind == 6, F.lit("00")))
    body = F.repeat(F.hex(F.encode(key.cast("string"), "UTF-8")), 10)
    return read_table(spark, sf_dir, "embeddings").filter(key.isNotNull()).select(
        key.alias("id"), F.unhex(F.when(kind == 5, head).otherwise(F.concat(head, body))).alias("content"))
