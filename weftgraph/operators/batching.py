"""Next-fit packing of rows into batches of a token budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from weftgraph.operators.numbering import ranged_rows
from weftgraph.plans.staging import materialize

#: Neighbouring ranges whose maps one task puts together.
FAN = 16
_MAP = "node long, before long, batches long, used long, total long, head long"


def _next_starts(costs: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums before each row (and after the last), and for each row that a batch begins with, the row that the next one begins with (the number of rows: none here)."""
    sums = np.r_[0, np.cumsum(costs)]
    n = len(costs)
    # a batch from i holds i, and rows on while their sum is at most room
    return sums, np.minimum(np.maximum(np.searchsorted(sums, sums[:-1] + room, side="right") - 1, np.arange(1, n + 1)), n)


def _entered(sums: np.ndarray, used: int, room: int) -> int:
    """The first row that doesn't fit into a batch open from before, of `used` so far."""
    return int(np.searchsorted(sums[1:], room - used, side="right"))


def range_map(costs: np.ndarray, room: int) -> pd.DataFrame:
    """What a range makes of the batch that is open where it begins: by the cost `before` the row that begins the first new batch, how many batches begin and what the last one holds; in stretches of such rows that lead to the same."""
    n = len(costs)
    sums, then = _next_starts(costs, room)
    # rows that may begin the first batch of the range: all that a batch open from before can reach
    most = min(_entered(sums, 0, room) + 1, n)
    last, count = np.arange(n), np.ones(n, np.int64)
    for i in range(n - 1, -1, -1):
        if then[i] < n:
            last[i], count[i] = last[then[i]], count[then[i]] + 1
    return _stretches(sums[:most], count[:most], sums[-1] - sums[last[:most]], int(sums[-1]), int(sums[1]))


def _stretches(before: np.ndarray, batches: np.ndarray, used: np.ndarray, total: int, head: int) -> pd.DataFrame:
    edge = np.flatnonzero(np.r_[True, (batches[1:] != batches[:-1]) | (used[1:] != used[:-1])])
    return pd.DataFrame({"before": before[edge], "batches": batches[edge], "used": used[edge], "total": total, "head": head})


def _follow(used: np.ndarray, batches: np.ndarray, m: pd.DataFrame, room: int) -> tuple[np.ndarray, np.ndarray]:
    """used and batches after a range with the map m, for many open batches at once."""
    total = int(m["total"].iloc[0])
    # the last stretch whose rows before it fit into the open batch
    at = np.maximum(np.searchsorted(m["before"].to_numpy(), room - used, side="right") - 1, 0)
    fits = used + total <= room
    return np.where(fits, used + total, m["used"].to_numpy()[at]), batches + np.where(fits, 0, m["batches"].to_numpy()[at])


def _maps(df: pd.DataFrame) -> list[tuple[int, pd.DataFrame]]:
    return [(int(node), m.sort_values("before")) for node, m in df.groupby("node", sort=True)]


def joined_maps(maps: list[pd.DataFrame], room: int) -> pd.DataFrame:
    """The map of ranges one after the other."""
    before, batches, used, passed = [], [], [], 0
    for i, m in enumerate(maps):
        reach = m[(m["before"] + passed <= room) | ((m["before"] == 0) & (not before))]
        u, n = reach["used"].to_numpy(), reach["batches"].to_numpy()
        for later in maps[i + 1 :]:
            u, n = _follow(u, n, later, room)
        before.append(reach["before"].to_numpy() + passed)
        used.append(u)
        batches.append(n)
        passed += int(m["total"].iloc[0])
    return _stretches(*map(np.concatenate, (before, batches, used)), passed, int(maps[0]["head"].iloc[0]))


def _entries(maps: DataFrame, nodes: int, room: int, guard_empty: bool) -> DataFrame:
    """node, used, number: the cost of the batch that is open where each range begins (-1: none yet), and its number. Maps of FAN neighbours are joined, those again, up to one; then states are handed down. Only states meet in a task
    with the maps of FAN ranges, and nothing in the driver."""
    levels = [materialize(maps, "maps")]
    width = nodes
    while width > FAN:
        width = -(-width // FAN)

        def up(df: pd.DataFrame) -> pd.DataFrame:
            return joined_maps([m for _, m in _maps(df)], room).assign(node=df["node"].iloc[0] // FAN)[[c.split()[0] for c in _MAP.split(", ")]]

        levels.append(materialize(levels[-1].withColumn("up", F.floor(F.col("node") / FAN)).groupBy("up").applyInPandas(lambda df: up(df.drop(columns="up")), _MAP), "maps"))
    states = maps.sparkSession.createDataFrame([(0, -1, 0)], "up long, used long, number long")

    def down(df: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        out, used, number = [], int(state["used"].iloc[0]), int(state["number"].iloc[0])
        for node, m in _maps(df):
            out.append((node, used, number))
            if used < 0:
                first = m.iloc[0]
                used, number = int(first["used"]), int(first["batches"]) - 1 + (not guard_empty and first["head"] > room)
            else:
                after, more = _follow(np.array([used]), np.array([0]), m, room)
                used, number = int(after[0]), number + int(more[0])
        return pd.DataFrame(out, columns=["node", "used", "number"])

    for level in reversed(levels):
        parents = level.withColumn("up", F.floor(F.col("node") / FAN))
        found = parents.groupBy("up").cogroup(states.groupBy("up")).applyInPandas(lambda df, state: down(df.drop(columns="up"), state), "node long, used long, number long")
        states = materialize(found, "entries").withColumnRenamed("node", "up")
    return states.withColumnRenamed("up", "node")


def next_fit(rows: DataFrame, cost: str, budget: int, reserve: int = 0, order: list | None = None, guard_empty: bool = True, segment_rows: int | None = None) -> DataFrame:
    """rows with batch_no (from 0), in an order.

    A row opens a new batch if the batch's cost, its own and the reserve exceed the budget; with guard_empty only if the batch has rows, else also before an oversize first row, which leaves an
    empty batch number. The reserve is added in each comparison and not kept. A null cost counts as 0; costs are not negative.

    Spark sorts by ranges. What a range makes of the batch that is open at its beginning is found for all such batches at once, as a map; maps of neighbouring ranges are joined in tasks, so that each range gets to know the batch that is
    open where it begins. Then each range numbers its own rows, as they stream through a task. Batches go on over ranges; the driver gets one state for each range. With segment_rows, batches begin anew every so many rows, and rows get
    segment too.
    """
    room = budget - reserve
    size = F.coalesce(F.col(cost).cast("long"), F.lit(0))
    placed = ranged_rows(rows, order or rows.columns)
    if segment_rows:
        place = F.col("__start") + F.col("__at")
        named = placed.withColumns({"segment": F.floor(place / segment_rows).cast("int"), "__in": place}).withColumn("__group", F.col("segment").cast("long"))
        entries: dict[int, tuple[int, int]] = {}
    else:
        named = placed.withColumns({"__group": F.col("__part").cast("long"), "__in": F.col("__at")})

        def mapped(df: pd.DataFrame) -> pd.DataFrame:
            return range_map(df.sort_values("at")["cost"].to_numpy(np.int64), room).assign(node=df["node"].iloc[0])[[c.split()[0] for c in _MAP.split(", ")]]

        maps = placed.select(F.col("__part").cast("long").alias("node"), F.col("__at").alias("at"), size.alias("cost")).groupBy("node").applyInPandas(mapped, _MAP)
        ranges = (placed.agg(F.max("__part")).first()[0] or 0) + 1
        entries = {r["node"]: (r["used"], r["number"]) for r in _entries(maps, ranges, room, guard_empty).collect()}
    known = rows.sparkSession.sparkContext.broadcast(entries)
    kept = [*rows.columns, *(["segment"] if segment_rows else [])]

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, used, number = None, -1, 0
        for df in batches:
            groups, out = df["__group"].to_numpy(), np.zeros(len(df), np.int32)
            edge = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True]) if len(df) else [0]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if groups[a] != group:
                    group = groups[a]
                    used, number = known.value.get(int(group), (-1, 0))
                costs = df["__cost"].to_numpy(np.int64)[a:b]
                sums, then = _next_starts(costs, room)
                at = 0 if used < 0 else _entered(sums, used, room)
                if used < 0:
                    number += (not guard_empty and costs[0] > room) - 1
                starts, last = np.zeros(b - a, np.int64), -1
                while at < b - a:
                    starts[at], last = 1, at
                    at = int(then[at])
                out[a:b] = number + np.cumsum(starts)
                number += int(starts.sum())
                used = used + int(sums[-1]) if last < 0 else int(sums[-1] - sums[last])
            yield df[kept].assign(batch_no=out)

    schema = StructType([*named.select(*kept).schema.fields, StructField("batch_no", IntegerType())])
    dealt = named.select(*kept, "__group", "__in", size.alias("__cost")).repartition("__group").sortWithinPartitions("__group", "__in")
    return dealt.mapInPandas(numbered, schema)


def embedding_batches(texts: DataFrame, cost: str, budget: int = 120_000, order: list | None = None) -> DataFrame:
    """Batches for an embedding model: one, unless all costs together exceed the budget."""
    total = texts.agg(F.sum(cost)).first()[0] or 0
    if total <= budget:
        return texts.withColumn("batch_no", F.lit(0))
    return next_fit(texts, cost, budget, 0, order, guard_empty=False)


def verification_batches(pairs: DataFrame, cost: str, budget: int = 4_000, reserve: int = 500, order: list | None = None) -> DataFrame:
    """Batches of pairs for a verifier."""
    return next_fit(pairs, cost, budget, reserve, order)
