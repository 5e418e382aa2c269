"""Small helpers shared by the operators of this package.

Input rules that hold for every operator: only the columns an operator names
are read, so extra columns (whatever their names) pass unseen; a null text is
an empty text; rows may repeat; tables may be empty.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.session import local_path, scratch_path, ship_package


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def id_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, body binary): the id and the whole text as UTF-8 bytes, null as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))


def bounded_chunks(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20):
    """Yield (ids, bodies) lists of at most ``most_bytes`` of text (or one
    text, if that alone is longer), so that a worker's memory doesn't depend
    on how long the texts of an Arrow batch are."""
    for batch in batches:
        ids, bodies, held = [], [], 0
        id_col, body_col = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            body = body_col[i].as_py()
            if held and held + len(body) > most_bytes:
                yield ids, bodies
                ids, bodies, held = [], [], 0
            ids.append(id_col[i].as_py())
            bodies.append(body)
            held += len(body)
        if ids:
            yield ids, bodies


class WordHashes(dict):
    """64-bit hash of each word (XXH64, seed 42), computed when first asked for; bounded in bytes."""

    ENTRY = 150      # bytes of an entry besides the word itself

    def __init__(self, most: int = 32 << 20):
        super().__init__()
        self.most, self.held = most, 0

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word, 42)
        if len(word) <= 64:
            self.held += len(word) + self.ENTRY
            if self.held > self.most:
                self.clear()
                self.held = len(word) + self.ENTRY
            self[word] = found
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def save_array(folder: str, name: str, a: np.ndarray) -> None:
    """An array file that appears whole: written under a name of its own, then renamed."""
    os.makedirs(folder, exist_ok=True)
    attempt = f"{folder}/.{name}.{uuid.uuid4().hex}.npy"
    np.save(attempt, a)
    os.replace(attempt, f"{folder}/{name}.npy")


def map_array(folder: str, name: str, size: int) -> np.ndarray:
    """An array file mapped into memory. The caller knows its length: a file that can't be seen or has
    another length is an error, never an empty array."""
    if not size:
        return np.zeros(0, np.uint64)
    path = f"{folder}/{name}.npy"
    try:
        a = np.load(path, mmap_mode="r")
    except (OSError, ValueError, EOFError) as e:
        raise RuntimeError(f"{path} can't be read here: spark.checkpoint.dir must be mounted on every "
                           f"worker and its files must last as long as the result ({e})") from e
    if len(a) != size:
        raise RuntimeError(f"{path} has {len(a)} entries instead of {size}")
    return a


def model_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder of the shared checkpoint directory that every worker can
    open as plain files (to map them into memory). The shared directory has to
    be a mounted file system (``file:`` or no scheme), as on clusters with an
    NFS or parallel file system; anything else is refused here, not later."""
    path = scratch_path(spark, name)
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"memory-mapped model files need spark.checkpoint.dir on a mounted "
                         f"shared file system; it is {path}")
    return local_path(path)


def prepare(spark: SparkSession) -> None:
    """Make the package importable in the Python workers."""
    ship_package(spark)
