"""Cells of near vectors, with bounds on what may be inside: the base of the registry's index and of the similarity joins.

A vector belongs to the nearest of a bounded number of centres. The vectors of a centre are cut into rings by their angle to it, of at most CELL_ROWS rows each: these are the cells. By the triangle inequality of angles no row
of a cell can be nearer to a query at angle a from the centre than a - (largest angle in the cell), nor than (smallest angle) - a. What that can't exclude must be looked at; the rest needn't be, and answers stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftgraph.plans.staging import materialize

CELL_ROWS = 2_048
#: Centres of one clustering: at most so many, and at most so many bytes of them; they are sent to all workers.
MOST_CENTRES, CENTRE_BYTES = 4_096, 16 << 20
#: What rounding may make of an angle.
SLACK = 1e-6


def unit_rows(vectors) -> np.ndarray:
    m = np.array(list(vectors), np.float64).reshape(len(vectors), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-10)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The angles between rows of a and rows of b, both of unit length (or zero)."""
    return np.arccos(np.clip(a @ b.T, -1, 1))


def least_angle(to_centre: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How near a row of a cell may be to a query at angle to_centre from its centre, when rows are at low to high from it."""
    return np.maximum(np.maximum(to_centre - high, low - to_centre) - SLACK, 0)


def least_angle_of_cells(between: np.ndarray, low_a, high_a, low_b, high_b) -> np.ndarray:
    """How near rows of two cells may be to each other, when their centres are at the angle `between`."""
    apart = np.maximum(np.maximum(between - high_a - high_b, low_a - high_b - between), low_b - high_a - between)
    return np.maximum(apart - 2 * SLACK, 0)


def pick_centres(rows: DataFrame, n: int, cell_rows: int) -> np.ndarray:
    """Vectors of rows (id, v), dealt by a hash of the id: about four for each cell, of which each of the centres in turn is the one furthest from those before. Their number and bytes are bounded; any centres give exact answers."""
    first = rows.select(F.size("v").alias("d")).first()
    if first is None:
        return np.zeros((0, 0))
    most = max(1, min(MOST_CENTRES, CENTRE_BYTES // (8 * first["d"])))
    wanted = min(most, ceil(n / cell_rows))
    if wanted == 1:
        return unit_rows([r["v"] for r in rows.orderBy(F.xxhash64("id")).limit(1).collect()])
    sample = unit_rows([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(min(4 * wanted, most)).select("v").collect()])
    picked, near = [0], 1 - sample @ sample[0]
    while len(picked) < min(wanted, len(sample)):
        picked.append(int(near.argmax()))
        near = np.minimum(near, 1 - sample @ sample[picked[-1]])
    return sample[picked]


def place(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """rows (id, v, ...) with centre and angle."""
    known = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if len(df):
                off = angles(unit_rows(df["v"]), known.value)
                near = off.argmin(1)
                yield df.assign(centre=near.astype(np.int32), angle=off[np.arange(len(df)), near])

    return rows.mapInPandas(run, StructType([*rows.schema.fields, *StructType.fromDDL("centre int, angle double").fields]))


def make_cells(rows: DataFrame, cell_rows: int = CELL_ROWS, n: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(placed, centres): rows (id, v, ...) sorted by centre and angle and stored, with centre, angle and cell (a number), at most cell_rows rows a cell.

    Spark sorts by ranges, so the rows of one centre, or very many equal vectors, are dealt over tasks; a cell ends where its range does.
    """
    n = rows.count() if n is None else n
    centres = pick_centres(rows, n, cell_rows)
    if not len(centres):
        return materialize(rows.withColumns({"centre": F.lit(0), "angle": F.lit(0.0), "cell": F.lit(0).cast("long")}), "cells"), centres
    placed = place(rows, centres)
    if n <= cell_rows:
        return materialize(placed.withColumn("cell", F.lit(0).cast("long")), "cells"), centres
    ranged = placed.repartitionByRange(max(1, ceil(n / (4 * cell_rows))), "centre", "angle", "id").sortWithinPartitions("centre", "angle", "id").withColumn("__at", F.monotonically_increasing_id())
    # a number for each centre's rows in each stretch of cell_rows rows of a range
    part, at = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    cell = (part * (1 << 24) + F.floor(at / cell_rows)) * (1 << 13) + F.col("centre")
    return materialize(ranged.withColumn("cell", cell.cast("long")).drop("__at"), "cells"), centres


def cell_table(placed: DataFrame) -> DataFrame:
    """cell, centre, n, low and high (the least and the largest angle of its rows to the centre)."""
    return placed.groupBy("cell").agg(F.first("centre").alias("centre"), F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))


def near_cell_pairs(cells: DataFrame, centres: np.ndarray, threshold: float) -> DataFrame:
    """i, j (i <= j): pairs of cells, a cell with itself included, that may hold two rows with a cosine of at least the threshold. Pairs of centres are excluded first, then pairs of cells."""
    spark = cells.sparkSession
    most = float(np.arccos(np.clip(threshold, -1, 1)))
    known = spark.sparkContext.broadcast(centres)
    wide = cells.groupBy("centre").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    spans = wide.toPandas()  # one row for each centre
    low, high = np.full(len(centres), np.inf), np.full(len(centres), -np.inf)
    low[spans["centre"]], high[spans["centre"]] = spans["low"], spans["high"]

    def centre_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for c in df["centre"]:
                between = angles(known.value[[c]], known.value)[0]
                may = np.flatnonzero((least_angle_of_cells(between, low[c], high[c], low, high) <= most) & (high >= low))
                yield pd.DataFrame({"a": np.full(len(may), c, np.int32), "b": may.astype(np.int32), "between": between[may]})

    pairs = wide.select("centre").mapInPandas(centre_pairs, "a int, b int, between double")
    one = lambda side: cells.select(F.col("centre").alias(side), F.col("cell").alias(f"cell_{side}"), F.col("low").alias(f"low_{side}"), F.col("high").alias(f"high_{side}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").filter("cell_a <= cell_b")
    apart = F.greatest(F.col("between") - F.col("high_a") - F.col("high_b"), F.col("low_a") - F.col("high_b") - F.col("between"), F.col("low_b") - F.col("high_a") - F.col("between")) - 2 * SLACK
    return both.filter(apart <= most).select(F.col("cell_a").alias("i"), F.col("cell_b").alias("j"))
