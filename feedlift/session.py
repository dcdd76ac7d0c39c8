"""Where intermediate tables go, and how a plan is cut.

Generated text, random batches and range-partitioned frames must be frozen before
a second job reads them: running the branch again could give other rows. They are
frozen as parquet tables in the shared folder named by ``spark.checkpoint.dir``, so
they outlive any executor.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"


def workspace(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is read from the session. Only a session that runs in this process alone, as in tests,
    may go without the setting; a folder of this machine is then named for it.
    """
    base = spark.conf.get(_CHECKPOINT_DIR, None)
    if base:
        return base.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"set {_CHECKPOINT_DIR} to a folder that all executors share")
    return _local_folder(spark.sparkContext.applicationId)


@cache
def _local_folder(application_id: str) -> str:
    return tempfile.mkdtemp(prefix=f"feedlift-{application_id}-")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{workspace(spark)}/feedlift/{label}-{uuid.uuid4().hex}"


# Where the frames of materialise are.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()

# Paths written inside each open scratch block, the innermost last.
_scratches: ContextVar[tuple[list[str], ...]] = ContextVar("scratches", default=())


def materialise(df: DataFrame, label: str = "frame", *, keep: bool = False) -> DataFrame:
    """Write ``df`` once and return a scan of what was written. With ``keep`` it outlives the
    innermost scratch block."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    blocks = _scratches.get()
    if keep:
        blocks = blocks[:-1]
    if blocks:
        blocks[-1].append(path)
    stored = spark.read.schema(df.schema).parquet(path)
    _paths[stored] = path
    return stored


def temporary_path(spark: SparkSession, label: str) -> str:
    """A new path that is deleted at the end of the innermost scratch block."""
    path = new_path(spark, label)
    blocks = _scratches.get()
    if blocks:
        blocks[-1].append(path)
    return path


def discard(*frames: DataFrame) -> None:
    """Delete what :func:`materialise` wrote for these frames, once nothing reads them any more."""
    for frame in frames:
        delete_path(frame.sparkSession, _paths.pop(frame))


def _located(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete_path(spark: SparkSession, path: str) -> None:
    store, at = _located(spark, path)
    store.delete(at, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    store, at = _located(spark, path)
    return store.exists(at)


def file_names(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern; none if its folder is missing."""
    store, at = _located(spark, pattern)
    return [str(f.getPath().toString()) for f in store.globStatus(at) or []]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Frames materialised inside are deleted at the end; nothing may read them later."""
    written: list[str] = []
    token = _scratches.set((*_scratches.get(), written))
    try:
        yield
    finally:
        _scratches.reset(token)
        for path in written:
            delete_path(spark, path)
