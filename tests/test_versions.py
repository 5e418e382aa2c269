"""Versioned replace-loads, builds by step, bucketed joins, lookups in written tables."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from vitrine.operators import recommend
from vitrine.plans import build, registry
from vitrine.schemas import PRODUCTS
from vitrine.session import scratch_path
from vitrine.sources import files, tables, versions


def numbers(spark, root):
    return sorted(r.n for r in versions.read_table(spark, root).collect())


def test_readers_keep_their_version_through_loads_and_failures(spark):
    root = scratch_path(spark, "versions-test")
    assert versions.current_version(spark, root) is None and versions.versions(spark, root) == []
    with pytest.raises(FileNotFoundError):
        versions.read_table(spark, root)
    versions.replace_table(spark.range(3).toDF("n"), root)
    opened = versions.read_table(spark, root)
    seen = []

    def stops(path):
        spark.range(100, 105).toDF("n").write.parquet(path)      # written whole, but never put in force
        seen.append(numbers(spark, root))
        raise RuntimeError("the load stops here")
    with pytest.raises(RuntimeError):
        versions.replace(spark, root, stops)
    assert seen == [[0, 1, 2]] and numbers(spark, root) == [0, 1, 2]
    versions.replace_table(spark.range(10, 12).toDF("n"), root)
    assert numbers(spark, root) == [10, 11] and sorted(r.n for r in opened.collect()) == [0, 1, 2]
    # A later load deletes what has been out of force for long; the last one before it stays for its readers.
    assert len(versions.versions(spark, root)) == 3
    current = versions.replace_table(spark.range(1).toDF("n"), root, grace=-1)
    assert len(versions.versions(spark, root)) == 2 and numbers(spark, root) == [0]
    assert current.endswith(versions.versions(spark, root)[-1])


def test_a_failed_build_leaves_the_old_one_in_force(spark):
    root = scratch_path(spark, "builds-test")
    raw = tables.raw_products(spark, SF_SMALL)
    out, audit = build.build(spark, raw, None, None, 0, out_root=root, steps=("products",))
    assert [r.table for r in audit.collect()] == ["products_clean", "products"] and build.current_build(spark, root) == out
    broken = raw.withColumn("title", F.when(F.col("title").isNotNull(), F.raise_error(F.lit("stop"))).cast("string"))
    with pytest.raises(Exception, match="stop"):
        build.build(spark, broken, None, None, 0, out_root=root, steps=("products",))
    assert build.current_build(spark, root) == out
    for steps in ((), ("other",), ("vectors",)):
        with pytest.raises(ValueError):
            build.build(spark, raw, None, None, 0, steps=steps)


def test_row_numbers_are_consecutive_in_the_order_of_the_rows(spark, tmp_path):
    names = [f"title {i}" for i in range(1000)]
    df = spark.createDataFrame([(n,) for n in names], "title string").repartitionByRange(7, "title").sortWithinPartitions("title")
    got = files.with_row_index(df, "product_id").collect()
    assert sorted(r.product_id for r in got) == list(range(1000))
    assert [r.title for r in sorted(got, key=lambda r: r.product_id)] == sorted(names)
    assert files.with_row_index(df.filter("title > 'title 99'").union(df.limit(0)), "id").count() == 10
    assert files.with_row_index(df.limit(0), "id").count() == 0


def test_a_catalogue_without_ids_prices_and_categories(spark):
    raw = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("NA",)], "title string").coalesce(1)
    out, _ = build.build(spark, raw, None, None, 0, steps=("products",))
    rows = sorted(tuple(r)[:6] for r in files.read_parquet(spark, out.products, PRODUCTS).collect())
    assert rows == [("0", "b", None, "", None, 0.0), ("1", "a", None, "", None, 0.0)]


def test_bucketed_join_has_no_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = registry.QUERIES["affinity_bucketed"](spark, SF_SMALL)
        plan = got._jdf.queryExecution().executedPlan().toString()
        join = plan[plan.index("SortMergeJoin"):]
        assert "Exchange" not in join.split("== ")[0] and "Bucketed: true" in join
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = recommend.category_affinity(tables.interactions(spark, SF_SMALL), registry.catalog(spark, SF_SMALL))
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


def test_lookup_in_the_written_table_reads_a_small_share(spark):
    """Clustered by id: the filter is pushed to the scan, and the statistics of one file in eight let it through."""
    import pyarrow.parquet as pq
    from vitrine.session import local_path
    raw = spark.range(20_000).select(F.format_string("P%05d", "id").alias("product_id"), F.format_string("t%d", "id").alias("title"),
                                     F.lit("c").alias("category"), F.lit("b").alias("brand"), F.lit(1.0).alias("price"))
    out = build.BuildOutput(scratch_path(spark, "lookup-test"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        build.write_products(raw, out)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    found = files.read_parquet(spark, out.products, PRODUCTS).filter(F.col("product_id") == "P12345")
    assert "EqualTo(product_id,P12345)" in found._jdf.queryExecution().executedPlan().toString()
    assert found.first().title == "t12345"
    places = []
    for file in files.read_parquet(spark, out.products).inputFiles():
        column = pq.ParquetFile(local_path(file)).metadata.row_group(0).column(0)
        places.append(column.statistics.min <= "P12345" <= column.statistics.max)
    assert len(places) == 8 and sum(places) == 1


def test_csv_files_of_different_headers(spark, tmp_path):
    from pyspark.sql import types as T
    (tmp_path / "a.csv").write_text("title,brand\nt1,b1\n")
    (tmp_path / "b.csv").write_text("brand,title\nb2,t2\n")
    (tmp_path / "c.csv").write_text("title,brand\nt3,b3\n")
    (tmp_path / "d.csv").write_text('"extra\nname",title\nx,t4\n')
    (tmp_path / "e.csv").write_text("")
    shape = T.StructType([T.StructField("title", T.StringType()), T.StructField("brand", T.StringType())])
    got = files.read_csv(spark, str(tmp_path), shape).collect()
    assert sorted(tuple(r) for r in got) == [("t1", "b1"), ("t2", "b2"), ("t3", "b3"), ("t4", None)]
