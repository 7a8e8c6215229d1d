"""Intermediate results as tables in shared storage.

A staged table cuts lineage, survives the loss of any executor, and is read back with column
pruning, so each later branch reads only the columns it needs.
"""

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_DIR = "spark.checkpoint.dir"
_scopes = threading.local()


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="nabd-")


def staging_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only for a single-machine session."""
    root = spark.conf.get(_DIR, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_DIR} to a folder that every executor can reach")
    return _local_root()


def staging_path(spark: SparkSession, name: str = "stage") -> str:
    return f"{staging_root(spark)}/nabd-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` once and continue from the written table."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    for paths in getattr(_scopes, "open", []):
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getName().startswith("nabd-"):
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(df: DataFrame) -> None:
    """Delete the files a staged table reads, once nothing needs it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end whatever this thread stages inside; write the results before that."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    paths: list[str] = []
    _scopes.open.append(paths)
    try:
        yield
    finally:
        _scopes.open.remove(paths)
        for path in paths:
            _delete(spark, path)
