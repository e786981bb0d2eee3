"""Whole-or-nothing writes and a lock, on any file system that Spark can reach."""

from __future__ import annotations

import contextlib
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import checkpoint_dir


def _path(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared store, which goes when the application ends."""
    uri = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path, store = _path(spark, uri)
    store.mkdirs(path)
    store.deleteOnExit(path)
    return uri


def write_whole(df: DataFrame, uri: str, kind: str = "parquet") -> None:
    """Write a table beside its place and move it there when it is complete.

    Readers see the old table or the new one.  The old one is moved aside first and comes back
    if the last step fails.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    target, store = _path(spark, uri)
    new, _ = _path(spark, f"{uri}.new-{mark}")
    old, _ = _path(spark, f"{uri}.old-{mark}")
    try:
        df.write.format(kind).save(f"{uri}.new-{mark}")
        had = store.exists(target)
        if had and not store.rename(target, old):
            raise OSError(f"cannot move {uri} aside")
        if not store.rename(new, target):
            if had:
                store.rename(old, target)
            raise OSError(f"cannot put {uri} in place")
        if had:
            store.delete(old, True)
    finally:
        store.delete(new, True)


@contextlib.contextmanager
def locked(spark: SparkSession, uri: str, wait: float = 10.0, stale: float = 3600.0):
    """Hold the lock file of a place: created exclusively, removed at the end.

    Waits so many seconds for another holder, then raises; a lock older than ``stale`` seconds
    counts as left behind and is taken over.
    """
    path, store = _path(spark, f"{uri}.lock")
    until = time.monotonic() + wait
    while True:
        try:
            store.create(path, False).close()
            break
        except Exception as e:  # Hadoop file systems differ in the exception of an existing file
            if not store.exists(path):
                raise OSError(f"cannot lock {uri}: {e}") from e
            if time.time() - store.getFileStatus(path).getModificationTime() / 1000 > stale:
                store.delete(path, False)
            elif time.monotonic() > until:
                raise TimeoutError(f"{uri} is locked") from None
            else:
                time.sleep(0.1)
    try:
        yield
    finally:
        store.delete(path, False)
