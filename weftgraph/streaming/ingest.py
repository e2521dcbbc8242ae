"""Documents as they arrive: each micro-batch is one ingest run."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.plans.ingest import Ingest
from weftgraph.plans.staging import materialize
from weftgraph.sources.documents import to_documents

#: Keeps state on the executors' disks, so that digests may be more than memory holds.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_documents(spark: SparkSession, folder: str, files_per_batch: int = 1_000) -> DataFrame:
    """The documents of a folder, at most files_per_batch files in a micro-batch."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
    return to_documents(reader.load(folder))


def ingest_stream(docs: DataFrame, ingest: Ingest, checkpoint: str) -> StreamingQuery:
    """Runs ingest over each micro-batch until no files are left. A content is ingested once: digests of contents are the state of a streaming deduplication, in the checkpoint, so a batch reads its own files and the state of its own digests, and no
    history. The registry keeps the number of the stream's last batch with what it brought: a batch that is repeated after a failure adds nothing twice. Which of several equal documents of one batch stays isn't said."""
    spark = docs.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        name = f"{checkpoint}:{number}"
        # a batch that was committed before a failure isn't run again, but its digests are kept
        if ingest.registry.has_batch(name):
            return rows.select("digest").write.format("noop").mode("overwrite").save()
        new = materialize(rows.select("uri", "content", "file_type"), "batch")
        if not new.isEmpty():
            ingest.run(new, name)

    once = docs.withColumn("digest", F.sha2("content", 256)).dropDuplicates(["digest"])
    with _setting(spark, "spark.sql.streaming.stateStore.providerClass", STATE_STORE):
        return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A query takes the session's settings when it starts; the session has its own again afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
