"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster.  Only where it is unset (tests, a single machine) is a
temporary folder of this machine used.  A table written here cuts the lineage: a lost executor costs a read, not a
recomputation, and nothing depends on blocks that live on one executor.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_WRITTEN: list[str] = []
_SCOPES = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only if the session names none and runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="hushframe-"))
    return _OWN[0]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hushframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._hushframe_path = path
    for made in getattr(_SCOPES, "open", [])[-1:]:
        made.append(out)
    return out


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """The list of tables that :func:`cut` makes in this thread while the scope is the innermost one."""
    _SCOPES.open = [*getattr(_SCOPES, "open", []), []]
    try:
        yield _SCOPES.open[-1]
    finally:
        _SCOPES.open = _SCOPES.open[:-1]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`cut` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_hushframe_path", None)
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            _delete(df.sparkSession, path)


def keep_only(made: list[DataFrame], *kept: DataFrame) -> None:
    """Delete the tables of a scope but those that a result still reads."""
    drop(*(df for df in made if not any(df is k for k in kept)))


def written(path: str) -> str:
    """Have :func:`release` delete this folder as well."""
    _WRITTEN.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete every table written by :func:`cut` in this process; call it when no result that uses them is needed."""
    n = len(_WRITTEN)
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())
    return n


def bounded_batches(spark: SparkSession) -> None:
    """Have Arrow batches of few megabytes unless the session has its own bound: rows with whole texts are large, and a
    batch exists several times, in the JVM's buffers and in the Python worker."""
    for key, default, own in (("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "2m"), ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000")):
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, own)
