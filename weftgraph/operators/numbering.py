"""Row numbers over all rows of a table, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.staging import materialize


def ranged_rows(df: DataFrame, order: list) -> DataFrame:
    """df sorted by ranges and stored, with __part (the range), __at (the place in it, from 0) and __start (rows in the ranges before)."""
    ranged = df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = materialize(ranged.withColumns({"__part": F.shiftright("__id", 33).cast("int"), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id"), "numbered")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return placed.join(F.broadcast(starts), "__part")


def number_rows(df: DataFrame, order: list, name: str = "row_no") -> DataFrame:
    """df with name: 0, 1, ... in an order. Spark sorts by ranges; only the ranges' row counts, one for each partition, meet in one task."""
    return ranged_rows(df, order).withColumn(name, F.col("__start") + F.col("__at")).drop("__part", "__start", "__at")
