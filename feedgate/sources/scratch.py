"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}
_scopes = threading.local()


def scratch_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local folder only for a local session."""
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="feedgate-")
    return _local_folders[app]


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/feedgate/{label}-{uuid.uuid4().hex}"
    for begun in getattr(_scopes, "open", [])[-1:]:
        begun.append(path)
    return path


@contextlib.contextmanager
def scoped(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables this thread begins inside, when the block is left."""
    _scopes.open = [*getattr(_scopes, "open", []), []]
    try:
        yield
    finally:
        for path in _scopes.open.pop():
            delete(spark, path)


def file_system(spark: SparkSession, path: str):
    """The Hadoop path object and its file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    found, system = file_system(spark, path)
    system.delete(found, True)


def save(frame: DataFrame, label: str, *partitions: str) -> DataFrame:
    """Write once, read many times: cuts the lineage at a table that outlives executors."""
    spark = frame.sparkSession
    path = new_path(spark, label)
    writer = frame.write.partitionBy(*partitions) if partitions else frame.write
    writer.option("compression", "zstd").parquet(path)  # digests are hex, which only entropy coding halves
    return spark.read.schema(frame.schema).parquet(path)
