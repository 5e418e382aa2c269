"""Replace-loads that readers can trust: versioned folders and a pointer.

A table (or a set of tables) lives under a root folder as versions
``v-<milliseconds>-<unique>``. A load writes a new version whole and only then
moves the pointer file ``_current`` over the old one, which the file system does
at once. Readers follow the pointer: before, during and after a failed load they
get the version in force, and the files of a version never change. A version
that no pointer names any more is deleted by a later load, after ``grace``
seconds, so a reader that has just opened it can finish.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

POINTER = "_current"      # names that begin with an underscore are no data to Spark
GRACE = 3600.0


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def current_version(spark: SparkSession, root: str) -> str | None:
    """The name of the version in force; None before the first load."""
    fs, pointer = _fs(spark, f"{root}/{POINTER}")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def current_path(spark: SparkSession, root: str) -> str:
    name = current_version(spark, root)
    if name is None:
        raise FileNotFoundError(f"nothing has been loaded under {root}")
    return f"{root}/{name}"


def _point(spark: SparkSession, root: str, name: str) -> None:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, pointer = _fs(spark, f"{root}/{POINTER}")
    _, attempt = _fs(spark, f"{root}/{POINTER}.{uuid.uuid4().hex}")
    out = fs.create(attempt, True)
    out.write(name.encode("utf-8"))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(pointer).toUri(), conf).rename(
        fs.makeQualified(attempt), fs.makeQualified(pointer), options)


def versions(spark: SparkSession, root: str) -> list[str]:
    """All version folders, oldest first."""
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory() and s.getPath().getName().startswith("v-"))


def replace(spark: SparkSession, root: str, write: Callable[[str], None], grace: float = GRACE) -> str:
    """Calls ``write(folder)`` for a new version's folder, puts it in force, and deletes those that have been out of
    force for ``grace`` seconds. If ``write`` fails, the old version stays in force. Returns the new folder."""
    root = root.rstrip("/")
    name = f"v-{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:12]}"
    write(f"{root}/{name}")
    before = current_version(spark, root)
    _point(spark, root, name)
    now = time.time() * 1000
    for old in versions(spark, root):
        # The last one in force has only now been replaced; a younger one may be a load that still runs.
        if old not in (name, before) and now - int(old.split("-")[1]) > grace * 1000:
            fs, path = _fs(spark, f"{root}/{old}")
            fs.delete(path, True)
    return f"{root}/{name}"


def replace_table(df: DataFrame, root: str, grace: float = GRACE) -> str:
    """One table as a new version."""
    return replace(df.sparkSession, root, lambda path: df.write.parquet(path), grace)


def read_table(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """The table in force when this is called."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(current_path(spark, root.rstrip("/")))
