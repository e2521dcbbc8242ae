"""The registry of canonical objects: tables in versions, and what adds to them."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import vector_index
from weftgraph.operators.numbering import number_rows
from weftgraph.plans.staging import file_system
from weftgraph.schemas import ANSWERS, CALLS, EDGES, NODES, OBJECTS, RELATIONSHIPS

TABLES = {"entities": OBJECTS, "relationship_types": OBJECTS, "relationships": RELATIONSHIPS, "nodes": NODES, "edges": EDGES, "answers": ANSWERS, "calls": CALLS}


def assign_ids(rows: DataFrame, start: int, order: list[str], name: str = "id") -> DataFrame:
    """rows with ids from start + 1 on, in an order: the same rows get the same ids, however they are dealt out."""
    numbered = number_rows(rows, order, "__row")
    return numbered.withColumn(name, F.col("__row") + start + 1).drop("__row")


def upsert_by_name(registry: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, absent) of objects: those whose name the registry has, with the least id of that name as reference; and one row, the least, for each name that it lacks."""
    names = registry.groupBy("name").agg(F.min("id").alias("reference"))
    known = objects.join(names, "name")
    absent = objects.join(names, "name", "left_anti").groupBy("name").agg(F.min("description").alias("description"))
    return known, absent


def update_embeddings(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """The registry with the embeddings of changes (id, seq, embedding), of several for a row the last by seq. Names and descriptions stay."""
    last = changes.groupBy("id").agg(F.max_by("embedding", "seq").alias("__new"))
    return registry.join(last, "id", "left").withColumn("embedding", F.coalesce("__new", "embedding")).select(*registry.columns)


class Conflict(Exception):
    """Another writer has made the version that a commit was to make."""


@dataclass(frozen=True)
class Part:
    """Rows that a commit has added, or several such parts merged. Of a delta, rows take the place of those of the same id in parts before it. level: how many times it was merged."""

    path: str
    rows: int
    largest: int
    delta: bool = False
    level: int = 0


class Registry:
    """Tables below a folder, each a log of parts. A version is one small file that names the parts of each table; a commit writes new parts, of what is added or changed only, and then that file, so a reader sees all of a commit or
    none. The file is written beside its place and renamed without overwriting: a reader never sees half of one, and of two writers one gets a Conflict. That needs a file system whose rename doesn't overwrite and is atomic, as HDFS
    and local disks have; on an object store without it let one writer at a time commit.

    Parts are merged as the log grows: MERGED neighbours of one level become one of the next, so a table of n commits has at most MERGED parts for each of log(n) levels, and a row is written again as often as there are levels. Version
    files before the last KEPT, and parts that only they name, are deleted; a reader that holds an older version must read it anew.

    The parts of object tables (those with an embedding) are segments of a vector index, see vector_index.py: search() and the self-join open their cells.
    """

    MERGED, KEPT = 8, 50

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    # versions

    def _listed(self) -> list[int]:
        at, fs = file_system(self.spark, f"{self.path}/versions")
        if not fs.exists(at):
            return []
        names = [str(f.getPath().getName()) for f in fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def _read(self, number: int) -> dict:
        at, fs = file_system(self.spark, f"{self.path}/versions/{number:012d}.json")
        source = fs.open(at)
        try:
            version = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()
        return version | {"tables": {name: [Part(**p) for p in parts] for name, parts in version["tables"].items()}}

    def _version(self) -> dict:
        """The last version: its number, its tables' parts and the batches so far: of numbered ones (`stream:number`) the last of each stream, of others the names."""
        for _ in range(10):
            there = self._listed()
            if not there:
                return {"version": 0, "tables": {}, "streams": {}, "names": []}
            try:
                return self._read(there[-1])
            except Py4JJavaError as failed:  # deleted since it was listed, as others have gone on
                if "FileNotFound" not in str(failed):
                    raise
        raise OSError(f"the versions of {self.path} change faster than they can be read")

    def _publish(self, version: dict) -> None:
        sc = self.spark.sparkContext
        folder = f"{self.path}/versions"
        beside, fs = file_system(self.spark, f"{folder}/.{uuid.uuid4().hex}.tmp")
        out = fs.create(beside, False)
        out.write(json.dumps(version | {"tables": {name: [asdict(p) for p in parts] for name, parts in version["tables"].items()}}).encode())
        out.close()
        at, _ = file_system(self.spark, f"{folder}/{version['version']:012d}.json")
        context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(at).toUri(), sc._jsc.hadoopConfiguration())
        none = sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = sc._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(fs.makeQualified(beside), fs.makeQualified(at), none)
        except Py4JJavaError as failed:
            fs.delete(beside, False)
            if "FileAlreadyExists" not in str(failed):
                raise
            raise Conflict(f"version {version['version']} of {self.path} is there already") from failed

    def _forget_old(self) -> None:
        """Deletes version files before the last KEPT, and the parts that no kept version names."""
        there = self._listed()
        old, kept = there[: -self.KEPT], there[-self.KEPT :]
        if not old:
            return
        named = lambda numbers: {p.path for n in numbers for parts in self._read(n)["tables"].values() for p in parts}
        # parts come and go in order, so what is gone by the first kept version is in no later one
        for path in named(old) - named(kept[:1]):
            at, fs = file_system(self.spark, path)
            fs.delete(at, True)
        for n in old:
            at, fs = file_system(self.spark, f"{self.path}/versions/{n:012d}.json")
            fs.delete(at, False)

    # tables

    def create(self) -> Registry:
        """Empty tables, where there are none; existing ones stay."""
        if not self._version()["tables"]:
            self.wipe()
        return self

    def wipe(self) -> None:
        """All tables empty, and no batch known."""
        self.commit(replaced={name: self.spark.createDataFrame([], schema) for name, schema in TABLES.items()}, forget=True)

    def parts(self, name: str) -> list[Part]:
        return self._version()["tables"].get(name, [])

    def table(self, name: str) -> DataFrame:
        """The rows of a table as of now, of each id the last."""
        return self._rows(name, self.parts(name))

    def _rows(self, name: str, parts: list[Part]) -> DataFrame:
        schema = TABLES[name]
        if not parts:
            return self.spark.createDataFrame([], schema)
        if not any(p.delta for p in parts[1:]):
            return self.spark.read.schema(schema).parquet(*[f"{p.path}/rows" for p in parts])
        rows = reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f"{p.path}/rows").withColumn("__seq", F.lit(i)) for i, p in enumerate(parts)])
        last = reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f"{p.path}/rows").select(F.col("id").alias("__of"), F.lit(i).alias("__last")) for i, p in enumerate(parts) if p.delta])
        last = last.groupBy("__of").agg(F.max("__last").alias("__last"))
        return rows.join(last, F.col("id") == F.col("__of"), "left").filter("__last is null or __seq >= __last").select(*schema.names)

    def segments(self, name: str) -> list[vector_index.Segment]:
        """The index of a table's vectors, a segment for each part. Rows that a later part has anew don't count."""
        parts, out = self.parts(name), []
        for i, p in enumerate(parts):
            later = [f"{x.path}/rows" for x in parts[i + 1 :] if x.delta]
            gone = self.spark.read.schema(TABLES[name]).parquet(*later).select(F.col("id").alias("ref")) if later else None
            out.append(vector_index.read_segment(self.spark, p.path, gone))
        return out

    def has_batch(self, batch: str) -> bool:
        """Whether a commit of this name, or a later one of its stream, is in the last version."""
        version = self._version()
        stream, number = _named(batch)
        return batch in version["names"] if number is None else number <= version["streams"].get(stream, -1)

    def _write(self, name: str, rows: DataFrame, number: int, written: list[str], delta: bool = False, level: int = 0) -> Part:
        at = f"{self.path}/{name}/{number}-{uuid.uuid4().hex}"
        written.append(at)
        schema = TABLES[name]
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
        if "embedding" in schema.names:
            vector_index.write_segment(rows, at)
        else:
            rows.write.parquet(f"{at}/rows")
        ids = F.max("id") if "id" in schema.names else F.lit(None)
        n, largest = self.spark.read.schema(schema).parquet(f"{at}/rows").agg(F.count(F.lit(1)), ids).first()
        return Part(at, n, largest or 0, delta, level)

    def commit(self, added: dict[str, DataFrame] | None = None, changed: dict[str, DataFrame] | None = None, replaced: dict[str, DataFrame] | None = None, batch: str | None = None, forget: bool = False) -> None:
        """A new version: rows added to tables, rows that take the place of those with their ids, tables replaced, and the name of the batch that they come from. What is empty writes no part."""
        old = self._version()
        number = old["version"] + 1
        tables = {name: list(parts) for name, parts in old["tables"].items()}
        written: list[str] = []
        named: set[str] = set()
        try:
            for name, df in (replaced or {}).items():
                part = self._write(name, df, number, written)
                tables[name] = [part] if part.rows else []
            for rows, delta in ((added or {}, False), (changed or {}, True)):
                for name, df in rows.items():
                    if not df.isEmpty():
                        tables[name] = self._merged(name, [*tables.get(name, []), self._write(name, df, number, written, delta)], number, written)
            stream, at = _named(batch) if batch else (None, None)
            streams = {} if forget else dict(old["streams"])
            names = [] if forget else [*old["names"], *([batch] if batch and at is None else [])]
            if at is not None:
                streams[stream] = max(at, streams.get(stream, -1))
            self._publish({"version": number, "tables": tables, "streams": streams, "names": names})
            named = {p.path for parts in tables.values() for p in parts}
        finally:  # what was merged at once, or is in no version after a failure
            for path in set(written) - named:
                folder, fs = file_system(self.spark, path)
                fs.delete(folder, True)
        self._forget_old()

    def _merged(self, name: str, parts: list[Part], number: int, written: list[str]) -> list[Part]:
        while len(parts) >= self.MERGED and len({p.level for p in parts[-self.MERGED :]}) == 1:
            last = parts[-self.MERGED :]
            rest = parts[: -self.MERGED]
            # with nothing before it, no row is taken the place of
            delta = bool(rest) and any(p.delta for p in last)
            parts = [*rest, self._write(name, self._rows(name, last), number, written, delta, last[0].level + 1)]
        return parts

    def largest_id(self, name: str) -> int:
        return max((p.largest for p in self.parts(name)), default=0)

    def preview(self, name: str, rows: int = 10) -> DataFrame:
        """The first rows by id."""
        return self.table(name).select("id", "name", "description").orderBy("id").limit(rows)


def _named(batch: str) -> tuple[str, int | None]:
    """The stream and the number of a batch named `stream:number`."""
    stream, _, number = batch.rpartition(":")
    return (stream, int(number)) if stream and number.isdigit() else (batch, None)
