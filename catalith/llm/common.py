"""Shared helpers: the shared folder, written intermediate tables, words."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words wherever this subpackage counts words.
WORD = r"[^\x20\x09-\x0D]+"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOCAL: dict[str, str] = {}
_PATHS: dict[int, tuple] = {}
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``.  Where that is unset, a local
    session gets a temporary folder; on a cluster that is an error, since a
    machine-local folder would lose data there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = context.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = "file://" + tempfile.mkdtemp(prefix="catalith-")
    return _LOCAL[key]


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a re-computation,
    and a table used several times is computed once.  Nothing reads the shuffles
    behind the table again, so Spark removes their files when the write is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out), path)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made and that nothing reads any more."""
    for df in tables:
        known, path = _PATHS.pop(id(df), (None, None))
        if known is not None and known() is df:
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


#: Rows and bytes of one Arrow batch between Spark and a Python worker.
BATCH_ROWS = 1_000
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, unless their path has it already."""
    root = str(Path(__file__).resolve().parents[2])
    context = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='catalith-')}/catalith", "zip", root, "catalith"))


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts; the settings stay in the session."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy() -> None:
    """Give freed memory back; Python workers live on from task to task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with small batches and workers that give memory back after each task."""
    bound_batches(df.sparkSession)

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidy()

    return df.mapInArrow(tidied, schema)
