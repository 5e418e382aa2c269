"""SimHash near-deduplication with covering locality-sensitive hashing.

A 64-bit fingerprint holds, per bit, the majority over the XXH64 hashes of the
text's word shingles. Two texts are linked when their fingerprints differ in
at most ``radius`` bits; a group is a connected component of links.

Covering hashing: bit position i gets the nonzero vector m(i) of r+1 bits, and
table v (one for each nonzero v) keeps the positions with <m(i), v> = 1. Any
r positions have some v orthogonal to all their vectors, and that table keeps
none of them: every pair within the radius meets in some table, none is lost.

Scale: the search runs over distinct fingerprints, so copies cost nothing. A
bucket larger than ``bucket_limit`` is not compared within one task but hashed
again by covering tables over the bits its own table left out, which is exact
for the same reason. Each round about halves the free bits (64, 30, 14, 6), so
a bucket of the third round holds at most 2**7 fingerprints: a proven bound.
Within a bucket only a spanning star of each linked set is emitted, never all
pairs; components are joined by alternating min-label rounds in Spark.

Defined results: null, empty and white-space texts have fingerprint zero and
are linked like any other; a text of fewer words than a shingle is one
shingle; rows that repeat an id are one node; null ids never name a component
unless it has no other id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import bounded_chunks, id_and_bytes, prepare, read
from vitrine.session import materialize

BITS = 64
BUCKET_LIMIT = 2048


def fingerprint(body: bytes, size: int = 3, seed: int = 42) -> int:
    """SimHash of the words of a text; A-Z lower-cased, words split at ASCII white space."""
    words = body.lower().split()      # of bytes: A-Z, and \x20 \x09-\x0D, alone
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        hashes = [digest(b" ".join(words), seed)]
    else:
        hashes = [digest(b" ".join(s), seed) for s in zip(*(words[i:] for i in range(size)))]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[at:at + (1 << 15)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(size: int, seed: int):
    def run(batches):
        for ids, bodies in bounded_chunks(batches):
            fps = np.array([fingerprint(b, size, seed) for b in bodies], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps)], ["doc_id", "fp"])
    return run


def covering_masks(radius: int, free: int = (1 << BITS) - 1) -> list[int]:
    """The 2**(radius+1) - 1 masks over the free bits; fixed bits stay in every mask."""
    positions = [i for i in range(BITS) if free >> i & 1]
    fixed, n = ~free & ((1 << BITS) - 1), (1 << (radius + 1)) - 1
    return [fixed | sum(1 << p for k, p in enumerate(positions) if (k % n + 1 & v).bit_count() & 1)
            for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _refine(radius: int):
    """Rows (mask, fp, node) of large buckets to the buckets of the next round."""
    def run(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            mask, fp, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for m in np.unique(mask).tolist():
                if m not in known:
                    masks = covering_masks(radius, ~m & ((1 << BITS) - 1))
                    known[m] = np.array(list(dict.fromkeys(masks)), np.uint64).view(np.int64)
                mine = mask == m
                for new in known[m]:
                    f = fp[mine]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(f), new)), pa.array(f & new), pa.array(f), pa.array(node[mine])],
                        ["mask", "key", "fp", "node"])
    return run


def linked_stars(fps: np.ndarray, nodes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(node, smallest node of its linked set) within one bucket, for all but the smallest."""
    order = np.argsort(nodes, kind="stable")
    fps, nodes = fps[order], nodes[order]
    left, out = np.arange(len(fps)), []
    while len(left) > 1:
        top, frontier, left = nodes[left[0]], left[:1], left[1:]
        while len(frontier) and len(left):
            near = np.zeros(len(left), bool)
            for at in range(0, len(frontier), 256):
                apart = np.bitwise_count(fps[frontier[at:at + 256], None] ^ fps[None, left])
                near |= (apart <= radius).any(axis=0)
            frontier, left = left[near], left[~near]
            out += [(int(n), int(top)) for n in nodes[frontier]]
    return out


def _stars(radius: int):
    def run(batches):
        for batch in batches:
            edges = []
            fp, node = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                f = fp[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                edges += linked_stars(f, node[i].values.to_numpy(zero_copy_only=False), radius)
            a, b = zip(*edges) if edges else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def links(nodes: DataFrame, radius: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Star edges (a, b), a > b, that connect what lies within the radius; ``nodes``: (fp, node)."""
    if bucket_limit < 128:
        raise ValueError("a bucket of the last round can hold 128 fingerprints")
    tables = F.array(*[F.lit(_signed(m)) for m in covering_masks(radius)])
    rows = (nodes.select(F.explode(tables).alias("mask"), "fp", "node")
            .select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp", "node"))
    found = []
    while True:
        counts = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        counts = materialize(counts, "simhash-buckets")
        shared = rows.join(counts, ["mask", "key"])
        buckets = (shared.filter(F.col("n") <= bucket_limit).groupBy("mask", "key")
                   .agg(F.collect_list("fp").alias("fp"), F.collect_list("node").alias("node")))
        found.append(buckets.select("fp", "node").mapInArrow(_stars(radius), "a long, b long"))
        if counts.filter(F.col("n") > bucket_limit).isEmpty():
            break
        large = shared.filter(F.col("n") > bucket_limit).select("mask", "fp", "node")
        rows = materialize(large.mapInArrow(_refine(radius), "mask long, key long, fp long, node long"),
                           "simhash-refined")
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest reachable node for every node of ``edges`` (a, b).

    Alternating rounds: every node's larger neighbours, then its smaller ones,
    are linked to the smallest neighbour. Rounds stop when the edge set stays
    the same; each is written to the shared folder, which cuts the lineage.
    """
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")),
                        "component-edges")

    def state(e):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .filter("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = materialize(small.select(F.col("b").alias("a"), F.col("m").alias("b"))
                            .unionByName(least.select("a", F.col("m").alias("b")))
                            .filter("a <> b").distinct(), "component-edges")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3, seed: int = 42,
                    bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    A fingerprint is its own node, so those of rows without an id link too; a
    component's name is the smallest id of all its rows."""
    prepare(docs.sparkSession)
    fps = materialize(id_and_bytes(docs).mapInArrow(_fingerprints(size, seed), "doc_id long, fp long"),
                      "simhash-fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    label = components(links(nodes.select("fp", F.col("fp").alias("node")), radius, bucket_limit))
    placed = (nodes.join(label, nodes["fp"] == label["node"], "left")
              .select("fp", "least", F.coalesce("component", "fp").alias("component")))
    # Names are looked up for components of several fingerprints alone; the others have their own.
    names = (placed.join(label.select("component").distinct(), "component", "left_semi")
             .groupBy("component").agg(F.min("least").alias("name")))
    named = (placed.join(names.withColumn("several", F.lit(True)), "component", "left")
             .select("fp", F.when(F.col("several"), F.col("name")).otherwise(F.col("least")).alias("component_id")))
    return (fps.join(named, "fp")
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """SimHash groups of all whole documents: 3-word shingles, at most 3 differing bits."""
    return near_duplicates(read(spark, sf_dir, "documents"))
