"""Shared scratch storage: where lineage is cut and staged tables are kept."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root and not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    root = root or sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="rowsieve-")
    sc.setCheckpointDir(root)
    return root


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is left there is dropped when Python ends."""
    path = f"{scratch_root(spark)}/rowsieve-{label}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


@atexit.register
def _drop_scratch() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in list(_SCRATCH):
            drop_path(spark, path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise a small frame reliably, so that its size can be looked at."""
    scratch_root(df.sparkSession)
    return df.checkpoint()


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` once to shared storage and continue from the written table.

    Unlike a checkpoint the staged table is columnar: later passes read only the
    columns they need. Whoever knows the last of these passes drops the path.
    """
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SHUFFLE_TARGET = 1 << 30


@contextmanager
def sized_shuffles(spark: SparkSession, nbytes: int):
    """Enough shuffle partitions for ``nbytes`` of input, never fewer than configured.

    Adaptive execution merges those that turn out small.
    """
    name = "spark.sql.shuffle.partitions"
    configured = spark.conf.get(name)
    spark.conf.set(name, str(max(int(configured), -(-nbytes // SHUFFLE_TARGET))))
    try:
        yield
    finally:
        spark.conf.set(name, configured)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of ``path`` as the cluster itself sees it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str | None:
    """``path`` as listings spell it, or None if nothing is there."""
    fs, p = hadoop_path(spark, path)
    return fs.makeQualified(p).toString() if fs.exists(p) else None


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)
    if path in _SCRATCH:
        _SCRATCH.remove(path)


@contextmanager
def dropped(spark: SparkSession, *paths: str | None):
    """Drop ``paths`` at the end, also when the work on them fails."""
    try:
        yield
    finally:
        for path in filter(None, paths):
            drop_path(spark, path)
