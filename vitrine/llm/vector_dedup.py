"""Embedding near-deduplication with int8 tile products and error bounds.

Equal vectors are one node. Nodes are dealt into blocks, and each pair of blocks
(a tile) meets in one task, so every pair of nodes is looked at exactly once:

1. A unit vector u is stored as s * q with entries q from -127 to 127. The
   rounding error r = |u - s q| is measured for each vector, and
   u.v <= s_u s_v (q_u.q_v) + |s_u q_u| r_v + r_u |s_v q_v| + r_u r_v
   bounds the cosine from above.
2. The tile's products of q are sums of integers, exact in the floats of a matrix
   product. Only pairs whose bound reaches the threshold are computed again from
   the vectors themselves in double precision; these cosines decide.
3. Of each tile only the number of links of each node and one edge to the
   smallest node of its linked set leave the task, never the pairs, however large
   a group of near copies is.

Components are joined by min-label rounds in Spark. A node's name is the smallest
id of its vectors.

Scale: the work is that of all pairs of distinct vectors, which the threshold and
whatever labels there are don't shorten. Each vector is sent to as many tiles as
there are blocks; a block holds ``block_bytes`` of vectors at most (a task's
memory), and there are enough blocks to keep the cluster busy.

Defined results: vectors that are null, empty or zero, or hold null or non-finite
entries, link with nothing, nor do vectors of different lengths; equal vectors
link. Rows that repeat an id are two vectors. Null ids name a component only if
it has no other id. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import prepare, read
from vitrine.llm.simhash import components
from vitrine.session import materialize

THRESHOLD = 0.95
BLOCK_BYTES = 16 << 20
CELLS = 1 << 22                 # products held at once
SLACK = 1e-9                    # far above the rounding of the bound itself


# -- a tile -----------------------------------------------------------------------------------------

def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q, s, |s q|, |u - s q|) of the unit vectors u of the rows of ``x``."""
    u = x / np.abs(x).max(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.abs(u).max(axis=1) / 127
    q = np.rint(u / s[:, None])
    back = q * s[:, None]
    return q, s, np.linalg.norm(back, axis=1), np.linalg.norm(u - back, axis=1)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the rows of ``x`` with those of ``y`` at the same place, in doubles."""
    return np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD, same: bool = False) -> np.ndarray:
    """Packed bits: which rows of ``x`` and ``y`` link. ``same``: both are one block, pairs count once (row < column)."""
    q, s, size, error = quantised(x)
    p, t, width, lost = (q, s, size, error) if same else quantised(y)
    kind = np.float32 if 127 * 127 * x.shape[1] < 1 << 24 else np.float64      # sums that stay exact
    q, p = q.astype(kind), np.ascontiguousarray(p.astype(kind).T)
    # Vectors are rows of any size: for full precision they are brought into a range whose squares are finite.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    y = x if same else y / np.abs(y).max(axis=1, keepdims=True)
    worst = float(size.max() * lost.max() + error.max() * width.max() + error.max() * lost.max())
    least = (threshold - worst - SLACK) / float(s.max() * t.max())      # no pair below this product can link
    out = np.zeros((len(x), -(-len(y) // 8)), np.uint8)
    step = max(1, CELLS // len(y))
    for at in range(0, len(x), step):
        product = q[at:at + step] @ p
        i, j = np.nonzero(product >= least)
        if same:
            above = i + at < j
            i, j = i[above], j[above]
        links = np.zeros(product.shape, bool)
        for cut in range(0, len(i), 1 << 18):
            a, b = i[cut:cut + (1 << 18)] + at, j[cut:cut + (1 << 18)]
            bound = (s[a] * t[b] * product[a - at, b] + size[a] * lost[b] + error[a] * width[b] + error[a] * lost[b])
            a, b = a[bound >= threshold - SLACK], b[bound >= threshold - SLACK]
            for c in range(0, len(a), 1 << 15):
                near = cosines(x[a[c:c + (1 << 15)]], y[b[c:c + (1 << 15)]]) >= threshold
                links[a[c:c + (1 << 15)][near] - at, b[c:c + (1 << 15)][near]] = True
        out[at:at + step] = np.packbits(links, axis=1, bitorder="little")
    return out


def _bits(packed: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(packed, axis=-1, count=n, bitorder="little").astype(bool)


def linked_sets(links: np.ndarray, n: int, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root of each row, root of each column): the smallest number in the set that links connect; -1: no link."""
    root_r, root_c = np.full(len(rows), -1, np.int64), np.full(n, -1, np.int64)
    left = np.flatnonzero(links.any(axis=1))
    while len(left):
        front, left = left[:1], left[1:]
        in_r, in_c = [front], np.zeros(n, bool)
        while len(front):
            reached = _bits(np.bitwise_or.reduce(links[front], axis=0), n) & ~in_c
            in_c |= reached
            mask = np.packbits(reached, bitorder="little")
            hit = (links[left] & mask).any(axis=1) if len(left) else np.zeros(0, bool)
            front, left = left[hit], left[~hit]
            in_r.append(front)
        in_r = np.concatenate(in_r)
        root = min(int(rows[in_r].min()), int(cols[in_c].min()))
        root_r[in_r], root_c[in_c] = root, root
    return root_r, root_c


def _tile(threshold: float):
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(key, table):
        a, b = key[1].as_py(), key[2].as_py()
        d, block = key[0].as_py(), table.column("block").to_numpy()
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        rows, cols = np.flatnonzero(block == a), np.flatnonzero(block == b)
        if not len(rows) or not len(cols):
            return schema.empty_table()
        links = tile_links(x[rows], x[cols], threshold, a == b)
        root_r, root_c = linked_sets(links, len(cols), node[rows], node[cols])
        n_r, n_c = np.zeros(len(rows), np.int64), np.zeros(len(cols), np.int64)
        step = max(1, CELLS // len(cols))
        for at in range(0, len(rows), step):
            bits = _bits(links[at:at + step], len(cols))
            n_r[at:at + step] = bits @ copies[cols]
            n_c += copies[rows[at:at + step]] @ bits
        columns = np.concatenate([np.stack([node[rows], n_r, root_r]), np.stack([node[cols], n_c, root_c])], axis=1)
        return pa.table([pa.array(c) for c in columns[:, columns[2] >= 0]], schema=schema)
    return run


# -- the operator --------------------------------------------------------------------------------------

def _usable(v):
    return F.coalesce(~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
                      & F.exists(v, lambda c: c != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id",
                    vec_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each vector: vec_id, n_links (other vectors linked directly), component_id (the smallest id reachable,
    its own included), kept (whether that is its own)."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0")
    spark = vectors.sparkSession
    prepare(spark)
    kind = vectors.schema[vec_col].dataType.simpleString()      # floats stay floats: half the bytes to shuffle
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                          F.col(vec_col).cast(kind if kind == "array<float>" else "array<double>").alias("v"))
    good = rows.filter(_usable(F.col("v")))
    nodes = good.groupBy("v").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    nodes = materialize(nodes.withColumns({"node": F.monotonically_increasing_id(), "d": F.size("v")}), "vector-nodes")
    # Enough blocks that each holds block_bytes at most, and that tiles keep every core busy twice.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    busy = int(np.ceil(np.sqrt(4 * tasks)))
    sizes = nodes.groupBy("d").agg(F.count(F.lit(1)).alias("n")).select(
        "d", F.greatest(F.ceil(F.col("n") * F.col("d") * 8 / F.lit(block_bytes)), F.lit(busy)).cast("int").alias("blocks"))
    dealt = (nodes.join(sizes, "d")
             .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    tiles = dealt.select("d", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"),
                         "block", "node", "copies", "v")
    # A number of its own: a tile's work is the product of its sides, so tasks aren't joined by their bytes.
    found = materialize(tiles.repartition(tasks, "d", "a", "b").groupBy("d", "a", "b")
                        .applyInArrow(_tile(threshold), "node long, links long, root long"), "vector-tiles")
    # A node meets a root in each of its tiles (as many as there are blocks): it is joined to the least of them, and
    # so are the others, which are few; the rounds then see one edge for each node instead of one for each tile.
    linked = materialize(found.groupBy("node").agg(F.sum("links").alias("links"), F.collect_set("root").alias("roots"))
                         .withColumn("least", F.array_min("roots")), "vector-linked")
    label = components(linked.select(F.col("node").alias("a"), F.col("least").alias("b")).unionByName(
        linked.select(F.explode("roots").alias("a"), F.col("least").alias("b")).distinct()))
    linked = linked.select("node", "links")
    known = (nodes.select("v", "node", "copies", "least").join(linked, "node", "left").join(label, "node", "left")
             .withColumn("component", F.coalesce("component", "node")))
    names = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = (known.join(names, "component")
             .select(F.col("v").alias("node_v"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    linked_rows = good.join(known, good["v"] == known["node_v"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~_usable(F.col("v"))).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                                     F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings: cosine of 0.95 or more."""
    return near_duplicates(read(spark, sf_dir, "embeddings"))
