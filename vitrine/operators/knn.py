"""Top-k nearest neighbours by cosine distance, exact and approximate.

Distances are ``1 - cos`` in double, floored at 0 and rounded to 6 decimals;
that rounded value is both the output and the ranking key, with the item id
as the unique tie-breaker. Vectors with zero norm have no distance and are
never ranked. A query may carry a list of allowed groups (categories): then
only items of those groups compete for its k places.

Two physical paths compute the same answer:

* **broadcast** -- the caller says that the query set is small (checked by
  reading at most ``max_broadcast_queries + 1`` rows; more are an error). Query vectors are broadcast; every
  item partition is scanned once by ``mapInArrow`` and keeps a running top-k
  per query, so items are never shuffled and each partition emits at most
  ``k`` hits per query.
* **blocked** -- the default, any size. Items and queries are grouped by category,
  each group is cut into hash blocks of ``block_rows`` items and
  ``query_block_rows`` queries, and every (item block, query block) pair of a
  group meets in one ``cogroup`` task. A hot group is therefore spread over
  many tasks, and only k hits per query leave a task. Every query block takes
  a copy of all items, so small blocks are kept only while they make
  ``MOST_BLOCKS`` pairs at most: beyond that blocks grow with the group, up to
  ``BLOCK_ROWS`` and ``QUERY_BLOCK_ROWS``, which bound a task's memory.

Both end with a per-query ``row_number() <= k`` over the candidate hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

from vitrine.functions.vectors import vector_fault
from vitrine.session import ship_package

MAX_BROADCAST_QUERIES = 20_000
MAX_BROADCAST_BYTES = 64 << 20
MAX_BROADCAST_MASK = 50_000_000   # queries x allowed groups in the broadcast filter
# Blocks of the blocked path: items are replicated ceil(queries / QUERY_BLOCK_ROWS)
# times and queries ceil(items / BLOCK_ROWS) times; one task holds one block
# of each (about 72 MB per side at 448 dimensions in float64).
BLOCK_ROWS = 20_000
QUERY_BLOCK_ROWS = 20_000
MOST_BLOCKS = 64   # pairs of blocks of a group, as long as blocks are smaller than that
LSH_BLOCK_ROWS = 2_000   # of few items: candidates are compared in many tasks
_CELLS_PER_CHUNK = 4_000_000  # query x item distances held at once in a task


# --------------------------------------------------------------------------
# numpy kernel
# --------------------------------------------------------------------------

def _round6(d: np.ndarray) -> np.ndarray:
    """Round non-negative values to 6 decimals, halves away from zero, as
    SQL ``round`` does (numpy's own rounding sends halves to even). The
    fraction ``y - floor(y)`` is exact in binary, so this matches
    ``round(y) / 1e6`` bit for bit, where ``floor(y + 0.5)`` could not."""
    y = d * 1e6
    r = np.floor(y)
    return (r + ((y - r) >= 0.5)) / 1e6


def _rank_within(keys: np.ndarray) -> np.ndarray:
    """0-based position of each element inside its run of equal sorted keys."""
    n = len(keys)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    starts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1]
    run_len = np.diff(np.r_[starts, n])
    return np.arange(n) - np.repeat(starts, run_len)


def select_topk(qidx: np.ndarray, item_ids: np.ndarray, dist: np.ndarray, k: int):
    """Keep the k smallest (dist, item_id) per query index."""
    order = np.lexsort((item_ids, dist, qidx))
    qidx, item_ids, dist = qidx[order], item_ids[order], dist[order]
    keep = _rank_within(qidx) < k
    return qidx[keep], item_ids[keep], dist[keep]


def block_topk(q_mat: np.ndarray, x_ids: np.ndarray, x_mat: np.ndarray, k: int,
               allowed: np.ndarray | None = None):
    """Exact top-k of every query row against every item row.

    ``q_mat`` (nq, d) and ``x_mat`` (nx, d) are float64; ``allowed`` is an
    optional (nq, nx) boolean filter. Returns (query index, item id,
    distance) arrays holding at most k rows per query.
    """
    nq, nx = q_mat.shape[0], x_mat.shape[0]
    empty = (np.zeros(0, np.int64), x_ids[:0], np.zeros(0, np.float64))
    if nq == 0 or nx == 0:
        return empty
    order = np.argsort(x_ids, kind="stable")
    x_ids, x_mat = x_ids[order], x_mat[order]
    if allowed is not None:
        allowed = allowed[:, order]
    q_norm = np.linalg.norm(q_mat, axis=1)
    x_norm = np.linalg.norm(x_mat, axis=1)
    bad_x = ~(x_norm > 0)
    kk = min(k, nx)
    chunk = max(1, _CELLS_PER_CHUNK // nx)
    out_q, out_i, out_d = [], [], []
    for start in range(0, nq, chunk):
        stop = min(nq, start + chunk)
        with np.errstate(divide="ignore", invalid="ignore"):
            d = 1.0 - (q_mat[start:stop] @ x_mat.T) / (q_norm[start:stop, None] * x_norm[None, :])
        d = _round6(np.maximum(d, 0.0))
        d[:, bad_x] = np.inf
        d[~(q_norm[start:stop] > 0), :] = np.inf
        if allowed is not None:
            d[~allowed[start:stop]] = np.inf
        d[np.isnan(d)] = np.inf
        kth = np.partition(d, kk - 1, axis=1)[:, kk - 1:kk]
        rows, cols = np.nonzero((d <= kth) & np.isfinite(d))
        qi, ii, dd = select_topk(rows + start, cols, d[rows, cols], kk)
        out_q.append(qi)
        out_i.append(x_ids[ii])
        out_d.append(dd)
    return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_d)


def _matrix(arr: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Arrow list column -> (valid-row mask, float64 matrix of valid rows)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    valid = arr.is_valid().to_numpy(zero_copy_only=False)
    lists = arr.filter(pa.array(valid))
    n = len(lists)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False) if n else np.zeros(0, np.int64)
    width = dim if dim is not None else (int(lengths[0]) if n else 0)
    if n and not (lengths == width).all():
        raise ValueError(f"vectors of unequal length (expected {width})")
    flat = lists.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    return valid, flat.reshape(n, width)


# --------------------------------------------------------------------------
# Spark plans
# --------------------------------------------------------------------------

def rankable(vec: str, dim: int | None = None) -> Column:
    """A vector that can have a distance (``functions.vectors.vector_fault``):
    no null, NaN or infinite entry, not all zeros, and of length ``dim`` where
    one is declared. Checked in the JVM before any vector reaches Python, so
    every path ranks the same rows."""
    v = F.col(vec)
    return vector_fault(v, dim if dim is not None else F.size(v)).isNull()


def _final_topk(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("distance").asc(), F.col("item_id").asc())
    return (hits.withColumn("rank", F.row_number().over(w))
                .filter(F.col("rank") <= k)
                .withColumn("rank", F.col("rank").cast("long")))


def _hit_schema(queries: DataFrame, items: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("item_id", items.schema["item_id"].dataType),
        T.StructField("distance", T.DoubleType()),
    ])


def _broadcast_path(items: DataFrame, qtable: pa.Table, k: int, grouped: bool) -> DataFrame:
    spark = items.sparkSession
    schema = _hit_schema_from(qtable, items)
    valid, q_mat = _matrix(qtable.column("query_vec"))
    q_ids = qtable.column("query_id").filter(pa.array(valid))
    allowed_codes = None
    codes: dict = {}
    if grouped:
        # a null group matches nothing (as in an equi-join)
        groups = [[g for g in (gl or []) if g is not None]
                  for gl in qtable.column("allowed").filter(pa.array(valid)).to_pylist()]
        for gl in groups:
            for g in gl:
                codes.setdefault(g, len(codes))
        allowed_codes = np.zeros((len(groups), len(codes) + 1), dtype=bool)
        for r, gl in enumerate(groups):
            for g in gl:
                allowed_codes[r, codes[g]] = True
        # Skip items of groups no query allows, before any vector reaches
        # Python (an IN list Spark can push down; for very many groups the
        # mask in the kernel filters alone).
        if not codes:
            items = items.filter(F.lit(False))
        else:
            items = items.filter(F.col("group").isin(list(codes)))
    payload = spark.sparkContext.broadcast((q_ids, q_mat, allowed_codes, codes))
    cols = ["item_id", "item_vec"] + (["group"] if grouped else [])
    item_type = to_arrow_type(schema["item_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid_arr, qm, acodes, code_of = payload.value
        dim = qm.shape[1]
        best_q = np.zeros(0, np.int64)
        best_i = None
        best_d = np.zeros(0, np.float64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ok, xm = _matrix(batch.column(1), dim)
            ids = batch.column(0).filter(pa.array(ok)).to_numpy(zero_copy_only=False)
            mask = None
            if acodes is not None:
                gvals = batch.column(2).filter(pa.array(ok)).to_pylist()
                gidx = np.array([code_of.get(g, -1) for g in gvals], dtype=np.int64)
                mask = acodes[:, gidx]  # code -1 selects the all-False last column
            qi, ii, dd = block_topk(qm, ids, xm, k, mask)
            if best_i is None:
                best_q, best_i, best_d = qi, ii, dd
            else:
                best_q, best_i, best_d = select_topk(
                    np.concatenate([best_q, qi]), np.concatenate([best_i, ii]),
                    np.concatenate([best_d, dd]), k)
        if best_i is None or len(best_q) == 0:
            return
        qcol = qid_arr.take(pa.array(best_q))
        yield pa.RecordBatch.from_arrays(
            [qcol.combine_chunks() if isinstance(qcol, pa.ChunkedArray) else qcol,
             pa.array(best_i, type=item_type),
             pa.array(best_d, type=pa.float64())],
            names=["query_id", "item_id", "distance"])

    hits = items.select(*cols).mapInArrow(run, schema)
    return hits


def _hit_schema_from(qtable: pa.Table, items: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", from_arrow_type(qtable.schema.field("query_id").type)),
        T.StructField("item_id", items.schema["item_id"].dataType),
        T.StructField("distance", T.DoubleType()),
    ])


def _block_counts(n_items: Column, n_queries: Column, block_rows: int, query_block_rows: int) -> tuple[Column, Column]:
    """Numbers of item and of query blocks of a group."""
    def count(n: Column, rows: int, full: int, most: Column) -> Column:
        return F.greatest(F.ceil(n / F.lit(max(rows, full))), F.least(F.ceil(n / F.lit(rows)), most)).cast("int")
    ib_n = count(n_items, block_rows, BLOCK_ROWS, F.lit(MOST_BLOCKS))
    # Item blocks first: they cost copies of the queries, which are the smaller side.
    room = F.greatest(F.floor(F.lit(MOST_BLOCKS) / F.greatest(ib_n, F.lit(1))), F.lit(1))
    return ib_n, count(n_queries, query_block_rows, QUERY_BLOCK_ROWS, room)


def _blocked_path(items: DataFrame, queries: DataFrame, k: int, grouped: bool,
                  block_rows: int, query_block_rows: int, planes: np.ndarray | None = None) -> DataFrame:
    """Hits of every pair of blocks; with ``planes`` of those pairs alone that share an LSH bucket."""
    schema = _hit_schema(queries, items)
    if grouped:
        qx = queries.select("query_id", "query_vec",
                            F.explode(F.array_distinct("allowed")).alias("group"))
        items = items.select("item_id", "item_vec", "group")
        n_items = items.groupBy("group").agg(F.count(F.lit(1)).alias("n_items"))
        n_queries = qx.groupBy("group").agg(F.count(F.lit(1)).alias("n_queries"))
        ib_n, qb_n = _block_counts(F.col("n_items"), F.col("n_queries"), block_rows, query_block_rows)
        blocks = n_items.join(n_queries, "group").select("group", ib_n.alias("ib_n"), qb_n.alias("qb_n"))
        items_j = items.join(blocks, "group")
        queries_j = qx.join(blocks, "group")
    else:
        # One group: block counts are scalar subqueries, not a join on a
        # constant key (which would plan as a nested-loop join).
        items_j = items.select("item_id", "item_vec", F.lit(0).alias("group"))
        queries_j = queries.select("query_id", "query_vec", F.lit(0).alias("group"))
        n_items = items_j.select(F.count(F.lit(1))).scalar()
        n_queries = queries_j.select(F.count(F.lit(1))).scalar()
        ib_n, qb_n = _block_counts(n_items, n_queries, block_rows, query_block_rows)
        items_j = items_j.withColumn("ib_n", ib_n).withColumn("qb_n", qb_n)
        queries_j = queries_j.withColumn("ib_n", ib_n).withColumn("qb_n", qb_n)
    more = []
    if planes is not None:      # hashed once, before the copies are made
        items_j = with_lsh_buckets(items_j, "item_vec", planes)
        queries_j = with_lsh_buckets(queries_j, "query_vec", planes)
        more = ["buckets"]
    items_b = (items_j
               .withColumn("ib", F.pmod(F.xxhash64("item_id"), F.col("ib_n")).cast("int"))
               .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qb_n") - 1)))
               .select("group", "ib", "qb", "item_id", "item_vec", *more))
    queries_b = (queries_j
                 .withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("qb_n")).cast("int"))
                 .withColumn("ib", F.explode(F.sequence(F.lit(0), F.col("ib_n") - 1)))
                 .select("group", "ib", "qb", "query_id", "query_vec", *more))
    q_type = to_arrow_type(schema["query_id"].dataType)
    i_type = to_arrow_type(schema["item_id"].dataType)

    def run(item_tab: pa.Table, query_tab: pa.Table) -> pa.Table:
        if item_tab.num_rows == 0 or query_tab.num_rows == 0:
            return pa.table({"query_id": pa.array([], q_type), "item_id": pa.array([], i_type),
                             "distance": pa.array([], pa.float64())})
        _, x_mat = _matrix(item_tab.column("item_vec"))
        _, q_mat = _matrix(query_tab.column("query_vec"))
        x_ids = item_tab.column("item_id").to_numpy()
        if planes is None:
            qi, ii, dd = block_topk(q_mat, x_ids, x_mat, k)
        else:
            q_ids = query_tab.column("query_id").to_numpy()
            qi, ii, dd = bucket_topk(q_ids, q_mat, _bucket_matrix(query_tab), x_ids, x_mat, _bucket_matrix(item_tab), k)
        return pa.table({"query_id": query_tab.column("query_id").take(pa.array(qi)),
                         "item_id": pa.array(ii, i_type), "distance": pa.array(dd, pa.float64())})

    # Arrow in and out: vectors reach numpy without per-row Python objects.
    hits = (items_b.groupBy("group", "ib", "qb")
            .cogroup(queries_b.groupBy("group", "ib", "qb"))
            .applyInArrow(run, schema))
    return hits


def similarity_topk(items: DataFrame, queries: DataFrame, k: int, *,
                    item_id: str = "item_id", item_vec: str = "item_vec",
                    item_group: str | None = None,
                    query_id: str = "query_id", query_vec: str = "query_vec",
                    query_allowed: str | None = None,
                    strategy: str = "blocked", dim: int | None = None,
                    max_broadcast_queries: int = MAX_BROADCAST_QUERIES,
                    block_rows: int = BLOCK_ROWS,
                    query_block_rows: int = QUERY_BLOCK_ROWS) -> DataFrame:
    """Exact top-k items per query: (query_id, item_id, distance, rank).

    ``item_group``/``query_allowed`` (an array column of groups) restrict
    each query to items of its allowed groups; both or neither must be set.
    With ``dim``, vectors of another length are left out like all that have
    no distance; without it they are an error.

    ``strategy`` is the caller's choice and never depends on the data:
    ``blocked`` (any number of queries, nothing reaches the driver) or
    ``broadcast`` (a query set that the caller knows to be small; one beyond
    the limits is refused, not cut).
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    ship_package(items.sparkSession)
    if (item_group is None) != (query_allowed is None):
        raise ValueError("item_group and query_allowed go together")
    grouped = item_group is not None
    it = items.select(F.col(item_id).alias("item_id"), F.col(item_vec).alias("item_vec"),
                      *([F.col(item_group).alias("group")] if grouped else []))
    it = it.filter(rankable("item_vec", dim))
    qcols = [F.col(query_id).alias("query_id"), F.col(query_vec).alias("query_vec")]
    if grouped:
        qcols.append(F.col(query_allowed).alias("allowed"))
    qs = queries.select(*qcols).filter(rankable("query_vec", dim))

    if strategy not in ("broadcast", "blocked"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "broadcast":
        probe = qs.limit(max_broadcast_queries + 1).toArrow()
        fits = (probe.num_rows <= max_broadcast_queries
                and probe.num_rows * max(_first_dim(probe), 1) * 8 <= MAX_BROADCAST_BYTES
                and (not grouped or probe.num_rows * (_n_groups(probe) + 1) <= MAX_BROADCAST_MASK))
        if fits and probe.num_rows == 0:
            # no query: nothing to rank, and no reason to scan the items
            schema = _hit_schema(qs, it).add("rank", T.LongType())
            return items.sparkSession.createDataFrame([], schema)
        if fits:
            hits = _broadcast_path(it, probe, k, grouped)
            return _final_topk(hits, k)
        raise ValueError("query set too large to broadcast")
    hits = _blocked_path(it, qs, k, grouped, block_rows, query_block_rows)
    return _final_topk(hits, k)


def _n_groups(table: pa.Table) -> int:
    """Distinct allowed groups over the probed queries."""
    col = table.column("allowed").combine_chunks()
    return len(pa.compute.unique(col.flatten())) if table.num_rows else 0


def _first_dim(table: pa.Table) -> int:
    if table.num_rows == 0:
        return 0
    col = table.column("query_vec").combine_chunks()
    return int(col.value_lengths()[0].as_py() or 0)


# --------------------------------------------------------------------------
# approximate search: random-hyperplane LSH + exact re-rank
# --------------------------------------------------------------------------

def hyperplanes(dim: int, n_tables: int, n_bits: int, seed: int) -> np.ndarray:
    """Gaussian hyperplanes, shape (n_tables, n_bits, dim)."""
    return np.random.default_rng(seed).standard_normal((n_tables, n_bits, dim))


def with_lsh_buckets(df: DataFrame, vec: str, planes: np.ndarray, out: str = "buckets") -> DataFrame:
    """Add ``array<long>``: one bucket per hash table, bit j set when
    v.r_j >= 0. One matrix product per Arrow batch; rows with a null vector
    get a null array."""
    ship_package(df.sparkSession)
    n_tables, n_bits, dim = planes.shape
    flat = planes.reshape(n_tables * n_bits, dim).T.copy()   # (dim, tables*bits)
    weights = (1 << np.arange(n_bits, dtype=np.int64))
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, mat = _matrix(batch.column(vec), dim)
            codes = ((mat @ flat) >= 0).reshape(-1, n_tables, n_bits).astype(np.int64) @ weights
            offsets = np.full(batch.num_rows + 1, 0, dtype=np.int32)
            offsets[1:] = np.cumsum(np.where(ok, n_tables, 0))
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.reshape(-1), pa.int64()),
                                             mask=pa.array(~ok))
            yield pa.RecordBatch.from_arrays(batch.columns + [lists], names=batch.schema.names + [out])

    return df.mapInArrow(run, schema)


def _bucket_matrix(table: pa.Table) -> np.ndarray:
    return _matrix(table.column("buckets"))[1].astype(np.int64)


def _bucket_rows(ids: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct buckets, row numbers sorted by bucket, where each bucket's rows begin and the last ones end): a row is
    in the buckets of every row of its id."""
    _, of = np.unique(ids, return_inverse=True)
    by_id = np.argsort(of, kind="stable")
    size = np.bincount(of)
    n_ids, first = len(size), np.cumsum(size) - size
    found, code = np.unique(buckets, return_inverse=True)
    pair = np.unique(code.reshape(-1) * n_ids + of)
    bucket, one = pair // n_ids, pair % n_ids
    n = size[one]
    rows = by_id[np.repeat(first[one], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    begin = np.searchsorted(np.repeat(bucket, n), np.arange(len(found) + 1))
    return found, rows, begin


def bucket_topk(q_ids: np.ndarray, q_mat: np.ndarray, q_buckets: np.ndarray, x_ids: np.ndarray, x_mat: np.ndarray,
                x_buckets: np.ndarray, k: int):
    """As ``block_topk``, of the pairs that share a bucket in any table (a column of the buckets): the k nearest of each
    bucket are ranked together, a pair found by several tables once."""
    order = np.argsort(x_ids, kind="stable")
    x_ids, x_mat, x_buckets = x_ids[order], x_mat[order], x_buckets[order]
    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float64)
    for t in range(q_buckets.shape[1]):
        x_found, x_rows, x_begin = _bucket_rows(x_ids, x_buckets[:, t])
        q_found, q_rows, q_begin = _bucket_rows(q_ids, q_buckets[:, t])
        _, at, to = np.intersect1d(q_found, x_found, assume_unique=True, return_indices=True)
        parts = [best]
        for a, b in zip(at, to):
            q, x = q_rows[q_begin[a]:q_begin[a + 1]], np.sort(x_rows[x_begin[b]:x_begin[b + 1]])
            # Rows are numbered by id: the number breaks ties as the id does.
            qi, xi, dd = block_topk(q_mat[q], x, x_mat[x], k)
            parts.append((q[qi], xi, dd))
        qi, xi, dd = (np.concatenate(c) for c in zip(*parts))
        _, one = np.unique(qi * len(x_ids) + xi, return_index=True)
        best = select_topk(qi[one], xi[one], dd[one], k)
    return best[0], x_ids[best[1]], best[2]


def lsh_topk(items: DataFrame, queries: DataFrame, k: int, *, dim: int,
             n_tables: int = 20, n_bits: int = 4, seed: int = 7,
             item_id: str = "item_id", item_vec: str = "item_vec",
             query_id: str = "query_id", query_vec: str = "query_vec") -> DataFrame:
    """Approximate top-k: exact distances only among items sharing a bucket.

    Each vector gets one bucket per hash table; a query's candidates are the
    items in any of its buckets. Items are scanned and hashed once and dealt to
    the blocks of the blocked path with their buckets; queries go to every item
    block, and there a query is compared with the rows of its buckets alone. A
    pair found by several tables counts once. Candidates are never shuffled,
    only k hits of a query and block are; a hot bucket is spread over all blocks.

    A table has 2**n_bits buckets, so a query meets about N / 2**n_bits items
    in each: let ``n_bits`` grow with the logarithm of the catalogue to keep
    the work per query level, and ``n_tables`` to keep the recall (below 1).
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    planes = hyperplanes(dim, n_tables, n_bits, seed)
    it = (items.select(F.col(item_id).alias("item_id"), F.col(item_vec).alias("item_vec"))
          .filter(F.col("item_id").isNotNull() & rankable("item_vec", dim)))
    qs = (queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("query_vec"))
          .filter(F.col("query_id").isNotNull() & rankable("query_vec", dim)))
    hits = _blocked_path(it, qs, k, False, LSH_BLOCK_ROWS, QUERY_BLOCK_ROWS, planes)
    return _final_topk(hits, k)
