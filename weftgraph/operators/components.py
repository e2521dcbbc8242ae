"""Connected components of an undirected graph."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftgraph.plans.staging import materialize

#: Edges of a file between rounds.
FILE_EDGES = 200_000


def _least(edges: DataFrame) -> DataFrame:
    """For each u the smallest of its neighbours v and itself."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """node, component for every node of an edge, where component is the smallest node that can be reached.

    Alternates two steps until nothing changes (about log of the longest path rounds): each node links its larger neighbours to
    the smallest it knows, then its smaller ones. Every round is a partial aggregation and a join by node, written to the shared folder;
    the driver sees one checksum a round, made while it is written. Self-loops give components of one node; rows with a null end are ignored.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null")
    counted = Observation()
    first = materialize(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().observe(counted, F.count(F.lit(1)).alias("n")), "edges")
    # a small graph's edges are few files: rounds of it are short tasks, of which there needn't be many
    files = max(1, ceil(counted.get["n"] / FILE_EDGES))
    now, before = first.filter("u <> v"), None
    for _ in range(most_rounds):
        both = now.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).distinct()
        seen = Observation()
        now = materialize(small.coalesce(files).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges")
        sign = seen.get
        if sign == before:
            break
        before = sign
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    nodes = first.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
