"""Shared folders, staged tables and session settings for the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes in one Arrow batch between the JVM and Python; a batch has at least one row, whatever its size.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master, where one machine does everything, gets a folder of its own when the setting is absent.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "tidemark-scratch")


_made: list[list[str]] = []


@contextlib.contextmanager
def tracked() -> Iterator[list[str]]:
    """The list of the paths that ``fresh_path`` gives out meanwhile."""
    _made.append([])
    try:
        yield _made[-1]
    finally:
        _made.pop()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one; it goes when the session's JVM ends, if nothing removes it before."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where.getParent())
    fs.deleteOnExit(where)
    for paths in _made:
        paths.append(path)
    return path


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` has not, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def release() -> None:
    """Give memory that is no longer used back to the system: Python workers live on for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function for mapInArrow, leaving its worker as small as before when its task ends."""

    @functools.wraps(run)
    def released(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return released


def staged(df: DataFrame, label: str, *, per_file: int = 1) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors.

    ``per_file``: so many shuffle partitions go to one file, for tables that are small beside their input.
    """
    path = fresh_path(df.sparkSession, label)
    if per_file > 1:
        df = df.coalesce(max(1, partitions(df.sparkSession) // per_file))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables whose successors have been written."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tuned(spark: SparkSession) -> SparkSession:
    """Bound the size of Arrow batches for the rest of the session: plans read these settings when they run. Lower
    settings of the user's own stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        own = spark.conf.get(key)
        if not own.rstrip("b").isdigit() or not 0 < int(own.rstrip("b")) <= most:
            spark.conf.set(key, str(most))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
