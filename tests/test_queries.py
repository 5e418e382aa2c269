"""Every registered query against its DuckDB SQL, plus the entry point.

Runs on sf0.001 by default (VITRINE_ORACLE_SF overrides); the driver runs
the same comparison at sf0.01.
"""

import pytest

import __spark_entry__ as entry
from conftest import SF_CHECK
from oracle_check import compare, duck
from vitrine.plans import registry

NAMES = sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_CHECK)


def test_every_query_has_sql():
    assert set(registry.QUERIES) - set(registry.ORACLE) == {"lsa_embed"}      # an SVD; tested in test_lsa.py
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF_CHECK)
    assert r["status"] in ("ok", "rows-only"), r


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "category", "n", "rank"]
    assert df.count() > 0


@pytest.mark.parametrize("name", ["user_top_categories", "recommend_all", "clean_products",
                                  "price_histogram", "knn_filtered"])
def test_same_result_for_any_shuffle_partitioning(spark, name):
    from oracle_check import canon
    results = []
    for n in (1, 4, 200):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        df = entry.queries()[name](spark, SF_CHECK)
        results.append(canon(df.columns, [tuple(r) for r in df.collect()]))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] == results[2]
