"""Folders that the driver and all executors share, and tables written there to cut lineage.

Tables and files that operators write there are read until their results have been used: remove_all() deletes them then.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir, or where that is unset and the master local an own temporary one. Its scheme is spelt out."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="pixelweave-")
        spark.sparkContext.setCheckpointDir(known)
    path = spark._jvm.org.apache.hadoop.fs.Path(known)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", full).rstrip("/")


_MADE: list[str] = []


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def files_at(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system for a path in the shared folder. It knows file, hdfs, viewfs, gs, abfs and s3 (also for s3a and s3n)."""
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and returns it reread: lost executors cost no recomputation."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._pixelweave_path = path
    return out


def remove(df: DataFrame) -> None:
    """Deletes the table behind a frame that cut() returned, once nothing reads it any more."""
    if path := getattr(df, "_pixelweave_path", None):
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
    if path in _MADE:
        _MADE.remove(path)


def written() -> set[str]:
    """What the operators have written to the shared folder and not deleted."""
    return {*_MADE}


def remove_all(spark: SparkSession, but: DataFrame | None = None, since: set[str] = frozenset()) -> None:
    """Deletes what the operators have written, but for what was written() before and for the table of one frame. No other frame they returned since can be read then."""
    kept = since | {getattr(but, "_pixelweave_path", None)}
    for path in [p for p in _MADE if p not in kept]:
        _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of frames that nothing refers to any more, instead of when the driver's garbage happens to be collected.

    Spark itself refers to the last job's frame until the next job, so there is one in between.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        spark.range(1).count()
    spark._jvm.System.gc()


_CACHES: dict[str, Callable[[], None]] = {}


def begin(name: str, forget: Callable[[], None] = lambda: None) -> None:
    """For a task in its Python worker, which Spark uses again and again: when it turns to another operator, what the others have cached is given back."""
    others = [n for n in _CACHES if n != name]
    for other in others:
        _CACHES.pop(other)()
    _CACHES[name] = forget
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))
