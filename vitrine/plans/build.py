"""The catalogue build: clean -> embed -> vector table -> served tables.

One function runs the steps, or those asked for, in order as Spark jobs and
writes every output as one new version of a folder of the shared checkpoint
directory, which comes into force when it is whole. Each step reads the
previous step's written table, so lineage is cut at every stage and a lost
executor only recomputes its own stage.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions.text import TEXT_DIM
from vitrine.functions.vectors import with_unit_vector
from vitrine.operators.clean import clean_products
from vitrine.operators.embed import product_vectors
from vitrine.operators.recommend import orphan_interactions
from vitrine.schemas import INTERACTIONS, PRODUCT_COLUMNS, PRODUCTS
from vitrine.session import scratch_path
from vitrine.sources import versions
from vitrine.sources.files import read_parquet, with_row_index, write_parquet


@dataclass
class BuildOutput:
    root: str

    @property
    def vectors(self) -> str:
        return f"{self.root}/vectors"

    @property
    def products(self) -> str:
        return f"{self.root}/tables/products"

    @property
    def interactions(self) -> str:
        return f"{self.root}/tables/interactions"

    @property
    def users(self) -> str:
        return f"{self.root}/tables/users"


def vector_table(catalog_vectors: DataFrame) -> DataFrame:
    """Rows of the vector collection: id, metadata, document text, the unit
    vector and its original norm."""
    v = with_unit_vector(catalog_vectors, "vector", "unit_vector", "norm")
    return v.select(
        F.col("product_id").cast("string").alias("id"),
        "product_id", "title", "category", F.col("price").cast("double").alias("price"),
        F.col("text").alias("document"), "vector", "unit_vector", "norm")


def write_vector_table(table: DataFrame, path: str) -> None:
    """Replace the collection: one overwrite, clustered by category so that a
    category filter skips files and row groups by their statistics. The
    rebalance hint lets AQE split a hot category over several writer tasks and
    merge small ones; there is no folder per category, so a category keeps its
    type and many categories don't mean many files."""
    (table.hint("rebalance", "category").sortWithinPartitions("category", "product_id")
     .write.mode("overwrite").parquet(path))


STEPS = ("products", "vectors", "interactions")


def write_products(raw_products: DataFrame, out: BuildOutput) -> None:
    """Cleans the catalogue and writes it clustered by id, so that a lookup reads few files and row groups. A catalogue
    without ids is numbered by row; absent columns take their defaults."""
    if "product_id" in raw_products.columns:
        cleaned = clean_products(raw_products)
    else:      # numbers, so that the first of equal titles stays
        numbered = with_row_index(raw_products, "product_id")
        cleaned = clean_products(numbered, "long").withColumn("product_id", F.col("product_id").cast("string"))
    write_parquet(cleaned.select(*PRODUCT_COLUMNS).repartitionByRange("product_id").sortWithinPartitions("product_id"),
                  out.products)


def write_interactions(interactions: DataFrame, out: BuildOutput) -> None:
    """Writes the log clustered by user (a user's filter skips files), and its users."""
    spark = interactions.sparkSession
    write_parquet(interactions.hint("rebalance", "user_id").sortWithinPartitions("user_id", "product_id"), out.interactions)
    inter = read_parquet(spark, out.interactions, interactions.schema)
    write_parquet(inter.select("user_id").filter(F.col("user_id").isNotNull()).distinct(), out.users)


def build(spark: SparkSession, raw_products: DataFrame, interactions: DataFrame | None,
          images: DataFrame | None, image_dim: int, out_root: str | None = None,
          text_dim: int = TEXT_DIM, steps: tuple[str, ...] = STEPS) -> tuple[BuildOutput, DataFrame]:
    """Run the build, or some of its steps; returns the output folders and an
    audit table (step, table, n_rows) read back from what was written.

    The tables are one version under ``out_root`` (``sources.versions``): it
    comes into force when all of them are written, so readers that ask
    ``current_build`` never see half a build, nor that of a failed one."""
    if not steps or set(steps) - set(STEPS):
        raise ValueError(f"steps are some of {STEPS}")
    if "vectors" in steps and "products" not in steps:
        raise ValueError("vectors are made of the products of the same build")

    def write(root: str) -> None:
        out = BuildOutput(root)
        if "products" in steps:
            write_products(raw_products, out)
        if "vectors" in steps:
            clean = read_parquet(spark, out.products, PRODUCTS)
            write_vector_table(vector_table(product_vectors(clean, images, image_dim, text_dim)), out.vectors)
        if "interactions" in steps:
            write_interactions(interactions, out)

    out = BuildOutput(versions.replace(spark, out_root or scratch_path(spark, "catalog-build"), write))
    written = [("products", out.products, "clean", "products_clean"), ("vectors", out.vectors, "embed", "vectors"),
               ("products", out.products, "tables", "products"), ("interactions", out.interactions, "tables", "interactions"),
               ("interactions", out.users, "tables", "users")]
    counts = [_count(spark, path, step, name) for of, path, step, name in written if of in steps]
    return out, reduce(DataFrame.unionByName, counts)


def current_build(spark: SparkSession, out_root: str) -> BuildOutput:
    """The tables of the build in force."""
    return BuildOutput(versions.current_path(spark, out_root.rstrip("/")))


def bucketed(df: DataFrame, key: str, n_buckets: int, name: str) -> DataFrame:
    """``df`` written in ``n_buckets`` sorted buckets of ``key`` (one file each) under the shared folder, and read as a
    table: joins and groupings on the key of two such tables need no exchange. Rows of one key stay in one bucket, so a
    key that holds a large share of the rows should be combined before, or joined by the shuffled plan, which AQE splits."""
    spark = df.sparkSession
    path, table = scratch_path(spark, name), f"{name.replace('-', '_')}_{uuid.uuid4().hex[:12]}"
    (df.repartition(n_buckets, key).write.mode("overwrite").option("path", path)
     .bucketBy(n_buckets, key).sortBy(key).saveAsTable(table))
    return spark.table(table)


def _count(spark: SparkSession, path: str, step: str, name: str) -> DataFrame:
    return read_parquet(spark, path).agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(step).alias("step"), F.lit(name).alias("table"), "n_rows")


def table_status(spark: SparkSession, out: BuildOutput) -> DataFrame:
    """Readiness of each written table: rows, null keys, orphans, ready.

    Orphans are interactions and vectors whose product is not in the products
    table, users without an interaction, and products without a vector. Ready
    means that the table has rows, no null key, and not only orphans: some
    are usual, since interactions may point at titles that the dedup dropped.
    """
    products = read_parquet(spark, out.products, PRODUCTS)
    inter = read_parquet(spark, out.interactions, INTERACTIONS)
    users = read_parquet(spark, out.users, T.StructType([INTERACTIONS["user_id"]]))
    vectors = read_parquet(spark, out.vectors, T.StructType([T.StructField("id", T.StringType()), PRODUCTS["product_id"]]))

    def stats(df: DataFrame, name: str, key: str, orphans: DataFrame) -> DataFrame:
        s = df.agg(F.count(F.lit(1)).alias("n_rows"),
                   F.count_if(F.col(key).isNull()).alias("n_null_keys"))
        n_orph = orphans.select(F.count(F.lit(1))).scalar()
        return s.select(F.lit(name).alias("table"), "n_rows", "n_null_keys",
                        n_orph.alias("n_orphans"),
                        ((F.col("n_rows") > n_orph) & (F.col("n_null_keys") == 0)).alias("ready"))

    def missing(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
        return df.join(other.select(key).distinct(), key, "left_anti")

    return (stats(products, "products", "product_id", missing(products, vectors, "product_id"))
            .unionByName(stats(vectors, "vectors", "id", missing(vectors, products, "product_id")))
            .unionByName(stats(inter, "interactions", "product_id",
                               orphan_interactions(inter, products)))
            .unionByName(stats(users, "users", "user_id", missing(users, inter, "user_id"))))
