"""Frames that several jobs read: materialised once, in shared storage where there is one."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries inside give their shuffle files back when they end, unless the session says otherwise.

    For jobs that write a table and are never read again: without this the files stay until the driver
    happens to collect garbage, so the jobs of a run add up on disk.
    """
    ours = spark.conf.get(_CLEANUP, None) in (None, "false")
    before = spark.conf.get(_CLEANUP, None)
    if ours:
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if ours and before is None:
            spark.conf.unset(_CLEANUP)
        elif ours:
            spark.conf.set(_CLEANUP, before)


def keep(frame: DataFrame) -> DataFrame:
    """Materialise a frame that several jobs read.

    With ``spark.checkpoint.dir`` set the rows go to that shared folder as a table, so a lost executor costs a
    re-read and not the whole lineage. Without it they are cached with spill to disk.
    """
    if frame.sparkSession.conf.get("spark.checkpoint.dir", None):
        return written(frame, "kept")
    return frame.persist(StorageLevel.MEMORY_AND_DISK)


def release(frame: DataFrame) -> None:
    """Drop a frame that ``keep`` made and that nothing reads any more."""
    path = getattr(frame, "_written_to", None)
    if path is None:
        frame.unpersist()
    else:
        _removed(frame.sparkSession, path)


_OWN: dict[str, str] = {}  # application to a folder of our own


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only where it is unset, on a single machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="relpredict-")
    return _OWN[app]


class _Made(threading.local):
    """Tables that this thread has written, in order."""

    def __init__(self):
        self.paths: list[str] = []


_MADE = _Made()


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` as a table in the shared folder: what is planned on it starts there."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with passing_shuffles(spark):
        frame.write.parquet(path, compression="zstd")
    _MADE.paths.append(path)
    found = spark.read.schema(frame.schema).parquet(path)
    found._written_to = path
    return found


@contextmanager
def cleared(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Removes the tables that are written inside, once that has ended, but for those put into the list it gives.

    A frame in the list that is only cached may not have been read yet: then all of them stay.
    """
    before = len(_MADE.paths)
    kept: list[DataFrame] = []
    yield kept
    if not all(hasattr(frame, "_written_to") for frame in kept):
        return
    own = _MADE.paths[before:]
    _MADE.paths[before:] = staying = [frame._written_to for frame in kept]
    for path in set(own) - set(staying):
        _removed(spark, path)


def _removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
