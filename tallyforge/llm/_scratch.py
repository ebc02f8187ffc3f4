"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Only a local session, whose
executors share the driver's disk, may go without: there a temporary folder takes its place.

Tables belong to the innermost open ``Scope`` of their thread and go when it ends. A table
that a result still reads is handed over to the scope around, at last to the process, and
goes by ``release`` or when the process ends.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import threading
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []
_results: list[str] = []
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)
_lock = threading.Lock()
_writers: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where none is set and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    with _lock:
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tallyforge-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


class _ShuffleFilesGo:
    """While any table is written, the shuffle files that led to it go with it; the session's own setting comes back after the last."""

    before = "false"

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self) -> None:
        with _lock:
            if not _writers:
                _ShuffleFilesGo.before = self.conf.get(_CLEANUP, "false")
                self.conf.set(_CLEANUP, "true")
            _writers.append("")

    def __exit__(self, *_: object) -> None:
        with _lock:
            _writers.pop()
            if not _writers:
                self.conf.set(_CLEANUP, _ShuffleFilesGo.before)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A table there outlives lost executors and cuts the lineage; columns are read as needed.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tallyforge/{name}-{uuid.uuid4().hex}"
    _held().append(path)
    with _ShuffleFilesGo(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _held() -> list[str]:
    held = _scope.get()
    return _results if held is None else held


class Scope:
    """Tables that are needed for a while: ``keep`` as above, all deleted at the end of the block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scope:
        self.token = _scope.set(self.paths)
        return self

    def hand_over(self, df: DataFrame, name: str) -> DataFrame:
        """Keep a table beyond the end of the block."""
        out = keep(df, name)
        path = self.paths.pop()
        inner = _scope.get()
        _scope.reset(self.token)
        _held().append(path)
        self.token = _scope.set(inner)
        return out

    def __exit__(self, *_: object) -> None:
        _scope.reset(self.token)
        _delete(self.spark, self.paths)
        sweep(self.spark)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> int:
    """Delete the tables that results of this process read, once none is needed any more; returns how many."""
    paths, _results[:] = list(_results), []
    _delete(spark, paths)
    return len(paths)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished steps now rather than at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
