"""Session construction and the shared working folder.

Everything the library writes (build outputs, round trips, lineage cuts) goes
under the folder the cluster names in ``spark.checkpoint.dir``. A folder of our
own is only created when that setting is absent, which is the case in local
tests. The one driver-local file is the package zip handed to ``addPyFile``,
which Spark itself then serves to the executors.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Session settings that hold for every job of the library.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app_name: str = "vitrine",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    Reads ``spark.checkpoint.dir`` (or the directory already set on the
    context). Only when neither is set -- local runs and tests -- a fresh
    folder is created and registered as the checkpoint directory.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="vitrine-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per context.

    Python stages (k-NN kernel, LSH signatures, model hooks) are functions of
    this package; a worker unpickling them must import it. The package is
    zipped on the driver and added with ``addPyFile`` -- what ``--py-files``
    does at submit time -- so it works wherever the driver was started.
    """
    sc = spark.sparkContext
    if getattr(sc, "_vitrine_shipped", False):
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    fd, path = tempfile.mkstemp(prefix="vitrine-pkg-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, _, names in os.walk(pkg_dir):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._vitrine_shipped = True


def materialize(df: DataFrame, name: str = "materialized") -> DataFrame:
    """Compute ``df`` once and cut its lineage: a Parquet table written in
    the shared folder and read back. Use where a costly intermediate is read
    more than once; a lost executor then re-reads files instead of
    recomputing, and (unlike an RDD checkpoint) each reader still gets
    column pruning and filter pushdown."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Paths handed out inside the innermost ``scratch`` blocks.
_OPEN_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Every intermediate written inside the block is deleted at its end, so a
    caller that has consumed its results (a written answer, collected rows)
    leaves nothing behind. Results that are still lazy must not leave the block."""
    _OPEN_SCRATCH.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _OPEN_SCRATCH.pop():
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder for one job's output."""
    base = shared_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    if _OPEN_SCRATCH:
        _OPEN_SCRATCH[-1].append(path)
    return path


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme so a local path can be listed from Python."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
    return os.path.normpath(path)
