"""A vector index in segments: cells with bounds that are stored beside the rows, and an exact search that opens only what may hold a better row.

A segment is written once, for the rows that one commit adds, and never changed; a search goes over all segments. It opens the most promising cell of each query first. What that finds, and the threshold, is a bound that
most other cells can't reach: only the others are opened then. Equal to a search of all rows, whatever the data; how much is spared depends on how the vectors stand together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.operators.cells import CELL_ROWS, angles, cell_table, least_angle, make_cells, unit_rows
from weftgraph.plans.staging import materialize

#: Queries that meet a cell in one task.
QUERY_ROWS = 2_048


@dataclass
class Segment:
    """rows: ref, v, cell. cells: cell, centre, n, low, high. centres: centre, v. gone: refs (a column ref) whose rows here no longer hold, as a later segment has them anew."""

    rows: DataFrame
    cells: DataFrame
    centres: DataFrame
    gone: DataFrame | None = None

    def live(self) -> DataFrame:
        return self.rows if self.gone is None else self.rows.join(self.gone, "ref", "left_anti")


def make_segment(objects: DataFrame, ref: str = "id", vector: str = "embedding", cell_rows: int = CELL_ROWS) -> Segment:
    """A segment of objects, for one search."""
    usable = objects.filter(F.size(vector) > 0).select(F.col(ref).alias("id"), F.col(vector).alias("v"))
    placed, centres = make_cells(usable, cell_rows)
    return Segment(placed.select(F.col("id").alias("ref"), "v", "cell"), materialize(cell_table(placed), "cell-table"), _centre_frame(objects.sparkSession, centres))


def _centre_frame(spark: SparkSession, centres: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, c) for i, c in enumerate(centres.tolist())], "centre int, v array<double>")


def write_segment(rows: DataFrame, path: str, ref: str = "id", vector: str = "embedding", cell_rows: int = CELL_ROWS) -> None:
    """Writes rows, with all their columns, below path as a segment: rows (sorted by cell, so that readers of few cells skip files and row groups), cells and centres. Rows without a vector stand beside the cells."""
    spark = rows.sparkSession
    has = F.coalesce(F.size(vector) > 0, F.lit(False))
    n = rows.filter(has).count()
    packed = rows.filter(has).select(F.col(ref).alias("id"), F.col(vector).alias("v"), F.struct(*rows.columns).alias("row"))
    placed, centres = make_cells(packed, cell_rows, n)
    bare = rows.filter(~has).select(*rows.columns, F.lit(None).cast("long").alias("cell"))
    placed.select("row.*", "cell").unionByName(bare).write.parquet(f"{path}/rows")
    cell_table(placed).coalesce(max(1, ceil(n / cell_rows / 100_000))).write.parquet(f"{path}/cells")
    _centre_frame(spark, centres).coalesce(1).write.parquet(f"{path}/centres")


def read_segment(spark: SparkSession, path: str, gone: DataFrame | None = None, ref: str = "id", vector: str = "embedding") -> Segment:
    rows = spark.read.parquet(f"{path}/rows").filter("cell is not null").select(F.col(ref).alias("ref"), F.col(vector).alias("v"), "cell")
    cells = spark.read.schema("cell long, centre int, n long, low double, high double").parquet(f"{path}/cells")
    return Segment(rows, cells, spark.read.schema("centre int, v array<double>").parquet(f"{path}/centres"), gone)


def _reachable(queries: DataFrame, centres: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], least: float) -> DataFrame:
    """id, segment, centre, angle: centres of cells that may hold a row with a cosine above `least`. The centres of all segments go to all workers; their number is bounded by that of the segments."""
    known = queries.sparkSession.sparkContext.broadcast(centres)
    most = float(np.arccos(np.clip(least, -1, 1)))
    kind = queries.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for at in range(0, len(df), 1_000):
                part = df.iloc[at : at + 1_000]
                q = unit_rows(part["v"])
                for s, (numbers, vectors, low, high) in enumerate(known.value):
                    off = angles(q, vectors)
                    x, y = np.nonzero(least_angle(off, low, high) <= most)
                    ids = part["id"].to_numpy(object if kind == "string" else None)[x]
                    yield pd.DataFrame({"id": pd.Series(ids, dtype=object if kind == "string" else None), "segment": np.full(len(x), s, np.int32), "centre": numbers[y].astype(np.int32), "angle": off[x, y]})

    return queries.mapInPandas(run, f"id {kind}, segment int, centre int, angle double")


def _open(queries: DataFrame, opened: DataFrame, segments: list[Segment], threshold: float, k: int) -> DataFrame:
    """src, ref, similarity: the k best rows above the threshold in each opened cell (id, segment, cell), for each query. A cell meets the queries that open it in blocks of a bounded number."""
    kinds = queries.schema["id"].dataType.simpleString(), segments[0].rows.schema["ref"].dataType.simpleString()
    asked = opened.groupBy("segment", "cell").agg(F.count(F.lit(1)).alias("asks")).withColumn("blocks", F.ceil(F.col("asks") / QUERY_ROWS).cast("int")).drop("asks")
    asks = opened.join(asked, ["segment", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).drop("blocks").join(queries, "id")
    there = None
    for s, segment in enumerate(segments):
        own = segment.live().join(asked.filter(F.col("segment") == s).drop("segment"), "cell").withColumns({"segment": F.lit(s), "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))}).select("segment", "cell", "block", "ref", "v")
        there = own if there is None else there.unionByName(own)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"src": [], "ref": [], "similarity": []})
        b = b.sort_values("ref")
        sims = unit_rows(a["v"]) @ unit_rows(b["v"]).T
        first = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        top = np.take_along_axis(sims, first, axis=1)
        x, y = np.nonzero(top > threshold)
        one = lambda values, kind: pd.Series(values, dtype=object if kind == "string" else None)
        src, ref = a["id"].to_numpy(object if kinds[0] == "string" else None), b["ref"].to_numpy(object if kinds[1] == "string" else None)
        return pd.DataFrame({"src": one(src[x], kinds[0]), "ref": one(ref[first[x, y]], kinds[1]), "similarity": top[x, y]})

    key = ["segment", "cell", "block"]
    return asks.groupBy(*key).cogroup(there.groupBy(*key)).applyInPandas(best, f"src {kinds[0]}, ref {kinds[1]}, similarity double")


def search(queries: DataFrame, segments: list[Segment], threshold: float, k: int) -> DataFrame:
    """src, ref, similarity: for each query (id, v) the k rows of all segments with the largest cosine above (not at) the threshold, ties to the smaller ref."""
    return search_counted(queries, segments, threshold, k)[0]


def search_counted(queries: DataFrame, segments: list[Segment], threshold: float, k: int) -> tuple[DataFrame, DataFrame]:
    """search(), and the cells that it opened: id, segment, cell."""
    spark = queries.sparkSession
    kinds = queries.schema["id"].dataType.simpleString(), segments[0].rows.schema["ref"].dataType.simpleString()
    queries = materialize(queries.select("id", "v"), "queries")
    wide = []
    for s in segments:
        spans = s.cells.groupBy("centre").agg(F.min("low").alias("low"), F.max("high").alias("high")).join(s.centres, "centre").toPandas()
        wide.append((spans["centre"].to_numpy(), unit_rows(spans["v"]), spans["low"].to_numpy(float), spans["high"].to_numpy(float)) if len(spans) else (np.zeros(0, int), np.zeros((0, 1)), np.zeros(0), np.zeros(0)))
    held = [i for i, w in enumerate(wide) if len(w[0])]
    if not held:
        nothing = spark.createDataFrame([], f"src {kinds[0]}, ref {kinds[1]}, similarity double")
        return nothing, spark.createDataFrame([], f"id {kinds[0]}, segment int, cell long")
    segments, wide = [segments[i] for i in held], [wide[i] for i in held]
    cells = None
    for i, s in enumerate(segments):
        own = s.cells.select(F.lit(i).alias("segment"), "cell", "centre", "low", "high")
        cells = own if cells is None else cells.unionByName(own)
    near = F.greatest(F.greatest(F.col("angle") - F.col("high"), F.col("low") - F.col("angle")) - 1e-6, F.lit(0.0))
    bounded = _reachable(queries, wide, threshold).join(cells, ["segment", "centre"]).withColumn("near", near).filter(F.col("near") <= float(np.arccos(np.clip(threshold, -1, 1))))
    bounded = materialize(bounded.select("id", "segment", "cell", "near", "angle"), "reachable")
    # the most promising cell first: the one that may be nearest, of equal ones that with the nearest centre
    first = bounded.groupBy("id").agg(F.min(F.struct("near", "angle", "segment", "cell")).alias("f")).select("id", "f.segment", "f.cell")
    first = materialize(first, "first-cells")
    found = materialize(_open(queries, first, segments, threshold, k), "first-found")
    # what a better row must beat: the k-th found so far
    reach = found.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("least")).filter(F.col("n") >= k).select(F.col("src").alias("id"), F.acos(F.least(F.greatest("least", F.lit(-1.0)), F.lit(1.0))).alias("most"))
    rest = bounded.join(first, ["id", "segment", "cell"], "left_anti").join(reach, "id", "left").filter(F.col("most").isNull() | (F.col("near") <= F.col("most") + 1e-6)).select("id", "segment", "cell")
    rest = materialize(rest, "other-cells")
    order = Window.partitionBy("src").orderBy(F.desc("similarity"), "ref")
    every = found.unionByName(_open(queries, rest, segments, threshold, k))
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank"), first.unionByName(rest)
