"""Category counts kept as state: the batch query's top categories, batch by batch and after a restart."""

import pytest

from conftest import SF_SMALL
from vitrine.operators import recommend
from vitrine.plans.registry import catalog, catalog_vectors
from vitrine.session import scratch_path
from vitrine.sources import tables, versions
from vitrine.streaming import requests
from vitrine.streaming.affinity import merge_counts, read_affinity, start_affinity


def top(affinity):
    return sorted(tuple(r) for r in recommend.top_categories(affinity).select("user_id", "category", "n", "rank").collect())


def test_state_equals_the_batch_query_over_batches_and_a_restart(spark):
    inter, products = tables.interactions(spark, SF_SMALL).cache(), catalog(spark, SF_SMALL)
    folder, out, ckpt = (scratch_path(spark, n) for n in ("affinity-in", "affinity-out", "affinity-ckpt"))
    parts = inter.randomSplit([1.0] * 4, seed=3)
    for part in parts[:3]:
        part.coalesce(1).write.mode("append").parquet(folder)
    start_affinity(spark, folder, products, out, ckpt, max_files_per_trigger=1).awaitTermination(300)
    first = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert top(read_affinity(spark, out)) == top(recommend.category_affinity(first, products))
    assert len(versions.versions(spark, out)) == 3      # one for each batch
    parts[3].coalesce(1).write.mode("append").parquet(folder)
    start_affinity(spark, folder, products, out, ckpt).awaitTermination(300)      # a restart reads the new file alone
    assert len(versions.versions(spark, out)) == 4
    want = recommend.category_affinity(inter, products)
    assert top(read_affinity(spark, out)) == top(want)
    assert sorted(tuple(r) for r in read_affinity(spark, out).collect()) == sorted(tuple(r) for r in want.select("user_id", "category", "n").collect())

    # Requests are answered from the counts as from the log.
    vecs, dim = catalog_vectors(spark, SF_SMALL, reuse=True)
    users = [r.user_id for r in inter.select("user_id").distinct().orderBy("user_id").limit(2).collect()] + ["nobody"]
    asked = spark.createDataFrame([(f"r{i}", u, 3 + 10 * i) for i, u in enumerate(users)], requests.RECOMMEND_REQUEST)
    answers = [sorted((tuple(r) for r in requests.answer_recommendations(asked, log, vecs, dim, counts).collect()), key=str)
               for log, counts in ((inter, None), (None, read_affinity(spark, out)))]
    assert answers[0] == answers[1] and any(r[-1] == requests.NO_HISTORY for r in answers[0])


def test_merging_a_replayed_batch_changes_nothing(spark):
    root = scratch_path(spark, "affinity-merge")
    rows = lambda *r: spark.createDataFrame(list(r), "user_id string, category string, n long")
    merge_counts(rows(("a", "x", 1), ("b", "x", 2)), root)
    for _ in range(2):
        merge_counts(rows(("a", "x", 3), ("a", "y", 1), (None, "x", 1)), root)
    got = sorted((tuple(r) for r in read_affinity(spark, root).collect()), key=str)
    assert got == sorted([("a", "x", 3), ("a", "y", 1), ("b", "x", 2), (None, "x", 1)], key=str)
    with pytest.raises(FileNotFoundError):
        read_affinity(spark, scratch_path(spark, "nothing"))
