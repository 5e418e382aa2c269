"""The inverted-list index: equal to the exact search, with few pairs scored and cells skipped with proof."""

import numpy as np
import pytest

from conftest import SF_CHECK
from vitrine.operators import cells, knn
from vitrine.sources import tables


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.item_id, round(r.distance, 6)) for r in df.collect())


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    data = [(i, None if v is None else [float(x) for x in v]) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>")


def both(spark, vec, queries, k=5, dim=64, **options):
    names = {"item_id": "vec_id", "item_vec": "embedding"}
    asked = {"query_id": "vec_id", "query_vec": "embedding"}
    index = cells.build_cells(vec, dim=dim, **names, **options)
    hits, stats = cells.cell_topk(index, queries, k, **asked)
    want = knn.similarity_topk(vec, queries, k, dim=dim, **names, **asked)
    assert rows_of(hits) == rows_of(want)
    return index, stats.first()


def test_equal_to_exact_with_a_tenth_of_the_pairs_scored(spark):
    """Vectors without any clusters: the codes' bounds alone leave few rows to score; recall is 1."""
    vec = tables.vectors(spark, "/root/testdata/sf0.1")
    _, stats = both(spark, vec, vec.filter("vec_id % 100 = 0"))
    assert stats.pairs == 20 * 2000 and stats.scored <= stats.pairs / 10, stats


def test_cells_are_skipped_with_proof(spark):
    """Clustered vectors: most cells can't hold a neighbour, and aren't read for a query."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 16))
    data = np.repeat(centres, 100, axis=0) + rng.standard_normal((3000, 16)) * 0.1
    vec = frame(spark, data)
    index, stats = both(spark, vec, vec.filter("vec_id % 50 = 0"), dim=16, n_cells=30)
    assert index.rows.sum() == 3000 and len(index.centroids) == 30
    assert stats.seen <= stats.pairs / 4 and stats.scored <= stats.pairs / 10, stats


def test_hot_cells_ties_and_unusable_rows(spark):
    """Copies beyond a chunk, ties at six decimals, null and zero vectors, other lengths, null ids."""
    rng = np.random.default_rng(4)
    copies = np.tile(rng.standard_normal(8), (700, 1))
    data = [*copies, *rng.standard_normal((300, 8)), None, np.zeros(8), np.full(8, np.nan), np.ones(5), *copies[:2] * 3]
    ids = [*range(1004), None, 1005]
    vec = frame(spark, data, ids)
    queries = vec.filter("vec_id % 90 = 0 OR vec_id > 990")
    names = {"item_id": "vec_id", "item_vec": "embedding"}
    index = cells.build_cells(vec, dim=8, n_cells=9, chunk_rows=50, **names)
    assert index.chunks().max() > 10
    hits, _ = cells.cell_topk(index, queries, 7, query_id="vec_id", query_vec="embedding")
    good = vec.filter("vec_id IS NOT NULL")
    want = knn.similarity_topk(good, queries, 7, dim=8, query_id="vec_id", query_vec="embedding", **names)
    assert rows_of(hits) == rows_of(want)


def test_few_rows_and_none(spark):
    rng = np.random.default_rng(5)
    vec = frame(spark, rng.standard_normal((3, 4)))
    both(spark, vec, vec, k=5, dim=4)
    empty = frame(spark, [])
    index = cells.build_cells(empty, dim=4, item_id="vec_id", item_vec="embedding")
    hits, stats = cells.cell_topk(index, vec, 5, query_id="vec_id", query_vec="embedding")
    assert hits.count() == 0 and tuple(stats.first()) == (0, 0, 0)
    with pytest.raises(ValueError):
        cells.cell_topk(index, vec, 0)


def test_many_query_blocks_and_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(cells, "QUERY_ROWS", 7)
    vec = tables.vectors(spark, SF_CHECK)
    both(spark, vec, vec.filter("vec_id % 10 = 0"), sample_rows=100)
