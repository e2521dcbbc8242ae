"""Cutting lineage: intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Tables written in each scratch() that is open, the innermost last.
_OPEN: list[list[str]] = []
#: Where materialize() has put what it returned.
_STORED: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a folder of this machine if the master is local, as in tests; else an error, as other machines wouldn't see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir is unset: set it to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="weftgraph-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and file system of an address."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(sc._jsc.hadoopConfiguration())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that materialize() writes inside are deleted at the end, also after an error, but for those with `keep`; these belong to the scratch() around this one, if there is one."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            at, fs = file_system(spark, path)
            fs.delete(at, True)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends there, so a lost executor costs no recomputation of what came before, and later jobs read only the columns that they use.

    The table is deleted when its scratch() ends (with `keep`, the next one outside), and in any case when the application does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at, fs = file_system(spark, path)
    fs.deleteOnExit(at)
    scopes = _OPEN[:-1] if keep else _OPEN
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    _STORED[stored] = path
    return stored


def discard(df: DataFrame) -> None:
    """Deletes a table that materialize() returned, before its scratch() ends: nothing may read it any more."""
    path = _STORED.pop(df)
    at, fs = file_system(df.sparkSession, path)
    fs.delete(at, True)
    for scope in _OPEN:
        if path in scope:
            scope.remove(path)
