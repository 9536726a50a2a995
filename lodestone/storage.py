"""Shared storage for intermediate tables.

Every table that an operator reads more than once, or whose lineage it cuts, is
written under the folder that the cluster names in ``spark.checkpoint.dir``.
All executors and the driver see that folder, so a lost executor loses nothing.
Only where the setting is absent in local mode (unit tests, a laptop) is a folder of
our own chosen; elsewhere the setting is required. Tables that nothing reads any
more are deleted with ``drop``, all of the application's with ``release``.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
#: Where a table that ``materialize`` gave back is written.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, as a Hadoop path or URI."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = os.path.join(tempfile.gettempdir(), "checkpoints", f"lodestone-{app}")
        os.makedirs(path, exist_ok=True)
        _FALLBACK[app] = path
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(path)
    return _FALLBACK[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Hadoop takes it from."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()


def delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` itself if it is a table that ``materialize`` gave, else such a table of it."""
    return df if df in _PATHS else materialize(df, label)


def drop(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these tables. Nothing that is still lazy may read them."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete everything that this application wrote in the shared folder."""
    delete(spark, f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` does, but keeps column pruning and
    size statistics for the plans that follow. The schema is given to the
    reader, so an empty table comes back with its columns.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out
