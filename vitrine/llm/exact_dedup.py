"""Exact deduplication with Patricia tries.

1. Every input task inserts its texts (whole byte strings) into a compressed
   radix trie and hands on one row per distinct text: length, content hash,
   bytes, the owner's id and the number of copies. A text that a third of all
   rows hold leaves a task once per flush of its trie.
2. These rows are dealt by (length, content hash). Each partition inserts the
   byte strings into a trie again; a terminal node keeps the owner's id (the
   smallest, or the largest as asked) and the sum of the copies, so equality
   is decided by the bytes and not by a hash. When the labels held exceed
   ``most_bytes``, the largest subtree is written to an anonymous spill file
   of the task and its later texts follow it there; at the end each spilled
   subtree is replayed into a trie of its own. The file is a working file of
   one task, lost and made again with it; nothing else reads it. Where only
   single texts are left below the branching node there is no smaller part to
   write, and the bound doubles: a trie then holds what its texts need, which
   more partitions make smaller.
3. Each terminal's SHA-256 addresses the group for its members: documents join
   it on (length, SHA-256). AQE splits the join where one text is hot.

Defined results: null and empty text are equal; a null id never owns a group
that has another id; rows that repeat an id with the same text are one
document and share its mark; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import bounded_chunks, id_and_bytes, prepare, read

PARTIAL = "length long, hash long, body binary, keep_id long, n long"
OWNERS = "length long, text_sha256 string, keep_id long, group_size long"
LABEL, CHILDREN, TERMINAL, OWNER, COUNT, SPILL = range(6)
RECORD = struct.Struct("<qq?q")      # bytes, owner, has owner, count


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Byte strings to (owner, count); ``pick`` chooses between two owners."""

    def __init__(self, pick: Callable[[int, int], int] = min, most_bytes: int | None = None):
        self.pick, self.most_bytes, self.held, self.spills = pick, most_bytes, 0, 0
        self.root = [b"", {}, False, None, 0, None]

    def insert(self, key: bytes, owner: int | None, n: int = 1) -> None:
        node, at, end = self.root, 0, len(key)
        while True:
            if node[SPILL] is not None:
                self._write(node[SPILL], key[at:], owner, n)
                return
            if at == end:
                break
            child = node[CHILDREN].get(key[at])
            if child is None:
                child = node[CHILDREN][key[at]] = [key[at:], {}, False, None, 0, None]
                self.held += end - at + 300        # 300: about what a node itself takes
                node, at = child, end
                continue
            label = child[LABEL]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            k = _shared(label, key[at:at + len(label)])
            mid = [label[:k], {label[k]: child}, False, None, 0, None]
            child[LABEL] = label[k:]
            node[CHILDREN][key[at]] = mid
            self.held += 300
            node, at = mid, at + k
        if not node[TERMINAL] or node[OWNER] is None:
            node[OWNER] = owner
        elif owner is not None:
            node[OWNER] = self.pick(node[OWNER], owner)
        node[TERMINAL] = True
        node[COUNT] += n
        if self.most_bytes and self.held > self.most_bytes:
            self._spill()

    @staticmethod
    def _write(file, suffix: bytes, owner: int | None, n: int) -> None:
        file.write(RECORD.pack(len(suffix), owner or 0, owner is not None, n) + suffix)

    @staticmethod
    def _walk(top: list) -> Iterator[tuple[bytes, list]]:
        """(path below ``top``, node) of every node of a subtree."""
        stack = [(b"", top)]
        while stack:
            path, node = stack.pop()
            yield path, node
            for child in node[CHILDREN].values():
                stack.append((path + child[LABEL], child))

    def _spill(self) -> None:
        """Write the largest subtree below the first branching node to a file."""
        top = self.root
        while len(top[CHILDREN]) == 1 and not top[TERMINAL]:
            (top,) = top[CHILDREN].values()
        sized = [(sum(len(x[LABEL]) + 300 for _, x in self._walk(c)), i, c)
                 for i, c in enumerate(top[CHILDREN].values()) if c[CHILDREN]]
        if not sized:            # nothing but single texts below: no smaller part to write
            self.most_bytes *= 2
            return
        took, _, child = max(sized)
        file = tempfile.TemporaryFile()      # has no name: gone with the task
        for path, node in self._walk(child):
            if node[SPILL] is not None:
                for suffix, owner, n in self._replay(node[SPILL]):
                    self._write(file, path + suffix, owner, n)
            elif node[TERMINAL]:
                self._write(file, path, node[OWNER], node[COUNT])
        child[CHILDREN], child[TERMINAL], child[OWNER], child[COUNT], child[SPILL] = {}, False, None, 0, file
        self.held -= took - len(child[LABEL]) - 300
        self.spills += 1

    @staticmethod
    def _replay(file) -> Iterator[tuple[bytes, int | None, int]]:
        file.seek(0)
        while head := file.read(RECORD.size):
            size, owner, owned, n = RECORD.unpack(head)
            yield file.read(size), owner if owned else None, n
        file.close()

    def items(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Every distinct string with its owner and count; frees the trie."""
        for path, node in self._walk(self.root):
            if node[SPILL] is not None:
                part = PatriciaTrie(self.pick, self.most_bytes)
                for suffix, owner, n in self._replay(node[SPILL]):
                    part.insert(suffix, owner, n)
                for suffix, owner, n in part.items():
                    yield path + suffix, owner, n
            elif node[TERMINAL]:
                yield path, node[OWNER], node[COUNT]
        self.root, self.held = [b"", {}, False, None, 0, None], 0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _emit(rows: Iterator[tuple], schema: pa.Schema, most_bytes: int = 4 << 20, sized: int | None = None):
    """Record batches of bounded size out of row tuples."""
    held, out = 0, []
    for row in rows:
        out.append(row)
        held += 100 + (len(row[sized]) if sized is not None else 0)
        if held > most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            held, out = 0, []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def _local_owners(pick, flush_bytes: int):
    schema = pa.schema([("length", pa.int64()), ("hash", pa.int64()), ("body", pa.binary()),
                        ("keep_id", pa.int64()), ("n", pa.int64())])

    def rows(trie):
        for key, owner, n in trie.items():
            yield len(key), _signed(xxhash.xxh64_intdigest(key)), key, owner, n

    def run(batches):
        trie = PatriciaTrie(pick)
        for ids, bodies in bounded_chunks(batches):
            for i, body in zip(ids, bodies):
                trie.insert(body, i)
            if trie.held > flush_bytes:
                yield from _emit(rows(trie), schema, sized=2)
        yield from _emit(rows(trie), schema, sized=2)

    return run


def _final_owners(pick, most_bytes: int):
    schema = pa.schema([("length", pa.int64()), ("text_sha256", pa.string()),
                        ("keep_id", pa.int64()), ("group_size", pa.int64())])

    def run(batches):
        trie = PatriciaTrie(pick, most_bytes)
        for batch in batches:
            body, keep, n = batch.column(2), batch.column(3), batch.column(4)
            for i in range(batch.num_rows):
                trie.insert(body[i].as_py(), keep[i].as_py(), n[i].as_py())
        yield from _emit(((len(key), hashlib.sha256(key).hexdigest(), owner, n)
                          for key, owner, n in trie.items()), schema)

    return run


def exact_groups(docs: DataFrame, keep: str = "min", flush_bytes: int = 32 << 20,
                 most_bytes: int = 64 << 20) -> DataFrame:
    """One row per distinct text: (length, text_sha256, keep_id, group_size)."""
    prepare(docs.sparkSession)
    pick = {"min": min, "max": max}[keep]
    local = id_and_bytes(docs).mapInArrow(_local_owners(pick, flush_bytes), PARTIAL)
    return local.repartition("length", "hash").mapInArrow(_final_owners(pick, most_bytes), OWNERS)


def exact_dedup(docs: DataFrame, keep: str = "min", **limits) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    owners = exact_groups(docs, keep, **limits)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.octet_length(text).cast("long").alias("length"), F.sha2(text, 256).alias("text_sha256"))
    return (rows.join(owners, ["length", "text_sha256"])
            .select("doc_id", "keep_id", "group_size",
                    F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    """Exact duplicates of all whole documents; of equal texts the largest doc_id stays."""
    return exact_dedup(read(spark, sf_dir, "documents"), keep="max")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
