"""Nearest neighbours from an inverted-list index, exact by error bounds.

Index. A coarse quantiser of ``n_cells`` unit centroids is trained in Spark by
spherical k-means over a sample of bounded size (``SAMPLE_ROWS``, by a hash of
the id). Every vector goes to its nearest cell; its residual from the centroid
is kept as int8 codes with a scale and the measured rounding error. The table is
written clustered by cell (the inverted lists); a small table tells each cell's
number of rows and its radius, the largest angle to its centroid.

Search. A query first looks at some rows of its nearest cells; the k-th best
cosine there can only be beaten. Then

* cells: the angle to a member is at least the angle to the centroid less the
  radius (the triangle inequality on the sphere); a cell that can't reach the
  k-th best is skipped with proof, and the query isn't sent there;
* rows: the codes give each cosine up to the error, so only rows whose upper
  bound reaches the k-th best lower bound are compared in full precision.

So the answer is that of ``knn.similarity_topk``, with a small part of the
pairs scored. Vectors are shuffled once, by cell and chunk (a chunk holds
``chunk_rows`` rows at most, so a hot cell is spread over many tasks), never by
candidate; queries are sent to the chunks they need. Only centroids and radii
reach the driver, and ``n_cells`` bounds them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vitrine.operators.knn import _final_topk, _matrix, _round6, rankable, select_topk
from vitrine.session import materialize, scratch_path, ship_package

SAMPLE_ROWS = 100_000     # of the training sample; more are never used
MOST_CELLS = 16_384       # the default number of cells is the root of the number of rows, up to this
ROUNDS = 4                # of k-means
CHUNK_ROWS = 20_000
QUERY_ROWS = 20_000       # queries of a block: the lists are read once for each
HOME_CELLS = 4            # cells whose rows open a search: those nearest to the query
HOME_ROWS = 2_000         # rows of each of them, about, by a hash of the id
ROUNDING = 2e-6           # distances are ranked at 6 decimals: what that may move


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors of rows that are not zero, of any size."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _near(u: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each unit vector."""
    out = np.empty(len(u), np.int64)
    for at in range(0, len(u), 4096):
        out[at:at + 4096] = (u[at:at + 4096] @ centroids.T).argmax(axis=1)
    return out


@dataclass
class CellIndex:
    spark: SparkSession
    path: str                 # inverted lists
    centroids: np.ndarray     # (cells, dim), unit vectors
    rows: np.ndarray          # rows of each cell
    radius: np.ndarray        # largest angle to the centroid, rounded up
    chunk_rows: int
    item_type: T.StructField

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def chunks(self) -> np.ndarray:
        return np.maximum(-(-self.rows // self.chunk_rows), 1)

    def lists(self) -> DataFrame:
        """The rows with their chunk, and whether they open searches from their cell."""
        cells = [(i, n, max(1, -(-rows // HOME_ROWS))) for i, (n, rows) in enumerate(zip(self.chunks().tolist(), self.rows.tolist()))]
        sizes = self.spark.createDataFrame(cells, "of_cell long, n_chunks long, share long")
        rows = self.spark.read.parquet(self.path)
        return (rows.join(F.broadcast(sizes), rows["cell"] == sizes["of_cell"])      # one small row for each cell
                .withColumn("chunk", F.pmod(F.xxhash64("item_id"), F.col("n_chunks")))
                .withColumn("opens", F.pmod(F.xxhash64("item_id", F.lit(2)), F.col("share")) == 0)
                .drop("of_cell", "n_chunks", "share"))


def train_centroids(items: DataFrame, dim: int, n: int, n_cells: int, sample_rows: int = SAMPLE_ROWS,
                    rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means over a bounded sample of the ``n`` rows of ``items`` (item_id, item_vec): assignment and sums
    in Spark."""
    place = F.pmod(F.xxhash64("item_id"), F.lit(1 << 40))
    sample = materialize(items.filter(place * F.lit(float(n)) < float(sample_rows) * (1 << 40)).select("item_id", "item_vec"), "cell-sample")
    first = sample.orderBy(F.xxhash64("item_id", F.lit(1)), "item_id").limit(n_cells).select("item_vec").toArrow()
    if not first.num_rows:
        return np.zeros((0, dim))
    centroids = _unit(_matrix(first.column("item_vec"), dim)[1])
    for _ in range(rounds):
        def sums(batches: Iterator[pa.RecordBatch], now=centroids) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros_like(now), np.zeros(len(now), np.int64)
            for batch in batches:
                u = _unit(_matrix(batch.column(0), dim)[1])
                cell = _near(u, now)
                np.add.at(total, cell, u)
                count += np.bincount(cell, minlength=len(now))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(total[some]), pa.list_(pa.float64()))], ["cell", "total"])
        parts = (sample.select("item_vec").mapInArrow(sums, "cell long, total array<double>")
                 .select("cell", F.posexplode("total").alias("i", "x")).groupBy("cell", "i").agg(F.sum("x").alias("x"))
                 .groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("total"))).collect()      # by cell
        moved = np.array(centroids)
        for r in parts:
            total = np.array(r.total)
            if np.linalg.norm(total) > 0:      # an empty cell keeps its centroid
                moved[r.cell] = total / np.linalg.norm(total)
        centroids = moved
    return centroids


def build_cells(items: DataFrame, *, dim: int, item_id: str = "item_id", item_vec: str = "item_vec",
                n_cells: int | None = None, sample_rows: int = SAMPLE_ROWS, chunk_rows: int = CHUNK_ROWS,
                path: str | None = None) -> CellIndex:
    """Train, assign and write the inverted lists of all rankable vectors of ``items``."""
    spark = items.sparkSession
    ship_package(spark)
    it = (items.select(F.col(item_id).alias("item_id"), F.col(item_vec).alias("item_vec"))
          .filter(F.col("item_id").isNotNull() & rankable("item_vec", dim)))
    n = it.count()
    if n_cells is None:
        n_cells = min(max(math.isqrt(n), 1), MOST_CELLS)
    centroids = train_centroids(it, dim, n, n_cells, sample_rows)
    shared = spark.sparkContext.broadcast(centroids)
    schema = T.StructType([*it.schema.fields, T.StructField("cell", T.LongType()), T.StructField("code", T.BinaryType()),
                           T.StructField("scale", T.DoubleType()), T.StructField("error", T.DoubleType()), T.StructField("angle", T.DoubleType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            u = _unit(_matrix(batch.column(1), dim)[1])
            cell = _near(u, c)
            rest = u - c[cell]
            scale = np.maximum(np.abs(rest).max(axis=1) / 127, 1e-30)
            code = np.rint(rest / scale[:, None])
            error = np.linalg.norm(rest - code * scale[:, None], axis=1)
            # The chord gives small angles better than the cosine does.
            angle = 2 * np.arcsin(np.minimum(np.linalg.norm(rest, axis=1) / 2, 1.0))
            codes = code.astype(np.int8).tobytes()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array([codes[i:i + dim] for i in range(0, len(codes), dim)], pa.binary()),
                 pa.array(scale), pa.array(error), pa.array(angle)], names=schema.names)

    path = path or scratch_path(spark, "cell-lists")
    (it.mapInArrow(assign, schema).hint("rebalance", "cell").sortWithinPartitions("cell")
     .write.mode("overwrite").parquet(path))
    rows, radius = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in spark.read.parquet(path).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect():      # by cell
        rows[r.cell], radius[r.cell] = r.n, r.radius + 1e-7
    return CellIndex(spark, path, centroids, rows, radius, chunk_rows, it.schema["item_id"])


def _cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, in doubles, by the formula of the other paths."""
    return np.einsum("ij,ij->i", q, x) / (np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1))


def _kernel(dim: int, k: int, centroids, id_types: tuple):
    """Per (cell, chunk): (query, item, distance) of each query's k nearest, and how many rows were scored for it."""
    q_type, i_type = id_types

    def run(items, queries):
        if not items.num_rows or not queries.num_rows:
            return pa.table({"query_id": pa.array([], q_type), "item_id": pa.array([], i_type), "distance": pa.array([], pa.float64()),
                             "scored": pa.array([], pa.int64()), "seen": pa.array([], pa.int64())})
        x, q = _matrix(items.column("item_vec"), dim)[1], _matrix(queries.column("query_vec"), dim)[1]
        ids = items.column("item_id").to_numpy()
        code = np.frombuffer(b"".join(items.column("code").to_pylist()), np.int8).reshape(-1, dim).astype(np.float32)
        scale, error = items.column("scale").to_numpy(), items.column("error").to_numpy()
        least = queries.column("least").to_numpy()
        unit = _unit(q)
        # Rounding of the product of floats, and of the distances that decide.
        slack = dim * 2.0 ** -22 + ROUNDING
        home = unit @ centroids.value[items.column("cell")[0].as_py()]
        out_q, out_i, out_d, scored = [], [], [], np.zeros(len(q), np.int64)
        step = max(1, 4_000_000 // len(x))
        for at in range(0, len(q), step):
            about = home[at:at + step, None] + (unit[at:at + step].astype(np.float32) @ code.T) * scale
            floor = least[at:at + step].copy()
            if len(x) >= k:
                kth = np.partition(about - error, len(x) - k, axis=1)[:, len(x) - k]
                floor = np.maximum(floor, kth)
            a, b = np.nonzero(about + error >= (floor - 2 * slack)[:, None])
            scored[at:at + step] = np.bincount(a, minlength=len(floor))
            for c in range(0, len(a), 1 << 16):
                aa, bb = a[c:c + (1 << 16)] + at, b[c:c + (1 << 16)]
                d = _round6(np.maximum(1.0 - _cosines(q[aa], x[bb]), 0.0))
                out_q.append(aa)
                out_i.append(bb)
                out_d.append(d)
        of = np.concatenate(out_q) if out_q else np.zeros(0, np.int64)
        row = np.concatenate(out_i) if out_i else np.zeros(0, np.int64)
        dist = np.concatenate(out_d) if out_d else np.zeros(0)
        of, item, dist = select_topk(of, ids[row], dist, k)
        # A query's counts ride on one row of its own, without an item.
        every = np.arange(len(q))
        return pa.table({
            "query_id": queries.column("query_id").take(pa.array(np.concatenate([of, every]))),
            "item_id": pa.concat_arrays([pa.array(item, i_type), pa.nulls(len(q), i_type)]),
            "distance": pa.concat_arrays([pa.array(dist, pa.float64()), pa.nulls(len(q), pa.float64())]),
            "scored": pa.concat_arrays([pa.nulls(len(of), pa.int64()), pa.array(scored)]),
            "seen": pa.concat_arrays([pa.nulls(len(of), pa.int64()), pa.array(np.full(len(q), len(x)))])})
    return run


def _search(index: CellIndex, items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Rows of ``_kernel`` for ``queries`` (query_id, query_vec, least, cell, chunk)."""
    shared = index.spark.sparkContext.broadcast(index.centroids)
    types = (to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(items.schema["item_id"].dataType))
    schema = T.StructType([queries.schema["query_id"], T.StructField("item_id", items.schema["item_id"].dataType),
                           T.StructField("distance", T.DoubleType()), T.StructField("scored", T.LongType()), T.StructField("seen", T.LongType())])
    # Queries in blocks of a bounded size; rows are sent to each of them.
    n = queries.select("query_id").distinct().count()
    blocks = max(1, -(-n // QUERY_ROWS))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    items = items.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return (items.groupBy("cell", "chunk", "block").cogroup(queries.groupBy("cell", "chunk", "block"))
            .applyInArrow(_kernel(index.dim, k, shared, types), schema))


def _sent(queries: DataFrame, index: CellIndex, home: bool) -> DataFrame:
    """Queries with the (cell, chunk) they are sent to: the home cells alone, or all cells that may reach ``least``."""
    dim, schema = index.dim, T.StructType([*queries.schema.fields, T.StructField("cell", T.LongType()), T.StructField("chunk", T.LongType())])
    shared = index.spark.sparkContext.broadcast((index.centroids, index.radius, index.rows, index.chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, radius, rows, chunks = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                u = _unit(_matrix(part.column(1), dim)[1])
                near = u @ c.T
                if home:
                    near[:, rows == 0] = -2
                    m = min(HOME_CELLS, int((rows > 0).sum()))
                    cell = np.argsort(-near, axis=1, kind="stable")[:, :m].ravel()
                    a, chunk = np.repeat(np.arange(len(u)), m), np.zeros(len(cell), np.int64)
                else:
                    angle = np.maximum(np.arccos(np.clip(near, -1, 1)) - radius - 1e-7, 0.0)
                    a, cell = np.nonzero((np.cos(angle) >= part.column(2).to_numpy()[:, None] - 2 * ROUNDING) & (rows > 0))
                    a, cell = np.repeat(a, chunks[cell]), np.repeat(cell, chunks[cell])
                    head = np.append(True, (a[1:] != a[:-1]) | (cell[1:] != cell[:-1])) if len(a) else np.zeros(0, bool)
                    chunk = np.arange(len(a)) - np.maximum.accumulate(np.where(head, np.arange(len(a)), 0)) if len(a) else a
                sent = part.take(pa.array(a))
                yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(cell), pa.array(chunk)], names=schema.names)
    return queries.mapInArrow(run, schema)


def cell_topk(index: CellIndex, queries: DataFrame, k: int, *, query_id: str = "query_id",
              query_vec: str = "query_vec") -> tuple[DataFrame, DataFrame]:
    """(query_id, item_id, distance, rank) of each query's k nearest, and one row (pairs, seen, scored): all pairs of a
    query and a row, those whose codes were read, and those compared in full precision."""
    if k < 1:
        raise ValueError("k must be at least 1")
    ship_package(index.spark)
    qs = (queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("query_vec"))
          .filter(F.col("query_id").isNotNull() & rankable("query_vec", index.dim)))
    schema = T.StructType([qs.schema["query_id"], index.item_type, T.StructField("distance", T.DoubleType()), T.StructField("rank", T.LongType())])
    counts = "pairs long, seen long, scored long"
    if not len(index.centroids):
        return index.spark.createDataFrame([], schema), index.spark.createDataFrame([(0, 0, 0)], counts)
    rows = index.lists()
    # The k-th best of rows of the home cells: a bound that only nearer rows can change.
    opened = _search(index, rows.filter("opens").withColumn("chunk", F.lit(0).cast("long")),
                     _sent(qs.withColumn("least", F.lit(-2.0)), index, True), k)
    opened = materialize(opened, "cell-home")
    bound = (opened.filter("item_id IS NOT NULL").groupBy("query_id")
             .agg(F.array_sort(F.collect_list("distance")).alias("far")).filter(F.size("far") >= k)      # k for each home cell
             .select("query_id", (F.lit(1.0) - F.element_at("far", k)).alias("least")))
    known = materialize(qs.join(bound, "query_id", "left").select(
        "query_id", "query_vec", F.coalesce("least", F.lit(-2.0)).alias("least")), "cell-queries")
    found = materialize(_search(index, rows, _sent(known, index, False), k), "cell-hits")
    seen, again = found.agg(F.sum("seen"), F.sum("scored")).first()
    first = opened.agg(F.sum("scored")).first()[0]
    stats = (known.count() * int(index.rows.sum()), seen or 0, (again or 0) + (first or 0))
    hits = found.filter("item_id IS NOT NULL").select("query_id", "item_id", "distance")
    return _final_topk(hits, k), index.spark.createDataFrame([stats], counts)
