"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import threading
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.staging import materialize, scratch

__all__ = ["Kept", "bound_batches", "give_back", "hot_keys", "load", "materialize", "n_words", "partitions", "scratch", "small_batches"]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of a data folder, as Spark reads it."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(df: DataFrame, key: str, most: int = 1000) -> DataFrame:
    """Keys that hold more than one in `most` of df's rows, so fewer than `most` keys: always small enough to broadcast."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    limit = df.count() / most
    return counts.filter(F.col("__n") > limit).select(key)


def n_words(text: Column) -> Column:
    """Words of [^\\x20\\x09-\\x0D]+ in a text."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most `rows` rows from now on in this session, so that a Python worker holds a few MB of texts at a time."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most `rows` rows for what runs inside; the session's setting is as before afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """What a task held goes back to the machine, as its worker may lie idle beside others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)  # where the C library can
    except (AttributeError, OSError):
        pass


class Kept:
    """What a Python worker has made and may need for its next task, by key. It goes when no task has asked for `seconds` after the last one was done: a worker lies idle, or serves other stages, beside others that need the memory."""

    def __init__(self, seconds: float = 2.0) -> None:
        self.seconds, self.lock = seconds, threading.Lock()
        self.held: dict[Hashable, object] = {}
        self.timer: threading.Timer | None = None

    def get(self, key: Hashable, make: Callable[[], object]) -> object:
        with self.lock:
            if self.timer:
                self.timer.cancel()
                self.timer = None
            if key not in self.held:
                self.held[key] = make()
            return self.held[key]

    def done(self) -> None:
        """A task needs nothing more for now."""
        with self.lock:
            if self.timer:
                self.timer.cancel()
            self.timer = threading.Timer(self.seconds, self._drop)
            self.timer.daemon = True
            self.timer.start()

    def _drop(self) -> None:
        with self.lock:
            self.held.clear()
            self.timer = None
        give_back()
