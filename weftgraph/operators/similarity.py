"""Pairs of similar objects by the cosine of their embeddings: exact, as products of blocks of near objects.

A task gets two blocks of at most BLOCK_ROWS rows and multiplies them, so what leaves it are the pairs asked for. Blocks are cells with bounds (operators/cells.py): two that can't hold a pair never meet. How many that spares depends on
the data: all but neighbours where objects stand in groups, few where they stand evenly in many dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from weftgraph.operators import vector_index
from weftgraph.operators.cells import CELL_ROWS, cell_table, make_cells, near_cell_pairs, unit_rows
from weftgraph.plans.staging import materialize

#: Rows of a block. A row is sent to a task for each block that its own may have pairs with, so blocks are large; a task makes SLICE_CELLS products at a time.
BLOCK_ROWS, SLICE_CELLS = 16_384, 1 << 22
THRESHOLD, EPSILON, CANDIDATES = 0.4, 0.05, 1


def _usable(objects: DataFrame, ident: str, vector: str) -> DataFrame:
    return objects.filter(F.size(vector) > 0).select(F.col(ident).alias("id"), F.col(vector).alias("v"))


def self_pairs(objects: DataFrame, threshold: float = THRESHOLD, ident: str = "id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, epsilon: float | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """src, dst, similarity for all ordered pairs of different objects with a cosine of at least the threshold. Objects without a vector have no pairs. Columns to carry come from both, as src_x and dst_x: pairs may be very many, so what is
    asked of their ends shouldn't be joined to them.

    Blocks are cells of near objects; two of them meet only where their bounds leave room for a pair. With epsilon, only pairs within epsilon of the best that src has in the same two blocks: a superset of what near_top() keeps, and
    all that it needs. Products are made of a few rows at a time, and pairs leave a task as they are found.
    """
    dealt, kind = block_pairs(objects, threshold, ident, vector, block_rows, carry), objects.schema[ident].dataType.simpleString()
    made = StructType([*StructType.fromDDL(f"src {kind}, dst {kind}, similarity double").fields, *[StructField(f"{end}_{c}", objects.schema[c].dataType) for c in carry for end in ("src", "dst")]])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        i, j, block = rows["i"][0].as_py(), rows["j"][0].as_py(), rows["block"].to_numpy()
        a, b = rows.take(np.flatnonzero(block == i)), rows.take(np.flatnonzero(block == j))
        if not len(a) or not len(b):
            return
        left, right = unit_rows(a["v"].to_pandas()), unit_rows(b["v"].to_pandas())
        step = max(1, SLICE_CELLS // len(right))

        def slices() -> Iterator[tuple[int, np.ndarray]]:
            for at in range(0, len(left), step):
                sims = left[at : at + step] @ right.T
                if i == j:
                    np.fill_diagonal(sims[:, at:], -1)
                yield at, sims

        def found(sims: np.ndarray, at: int, best: np.ndarray | None, swapped: bool) -> pa.RecordBatch:
            x, y = np.nonzero(sims >= (threshold if best is None else np.maximum(threshold, best - epsilon)))
            ends = (b.take(y), a.take(x + at)) if swapped else (a.take(x + at), b.take(y))
            columns = [ends[0]["id"], ends[1]["id"], pa.chunked_array([pa.array(sims[x, y])]), *[end[c] for c in carry for end in ends]]
            return pa.Table.from_arrays(columns, names=made.names).combine_chunks()

        tops = None
        if epsilon is not None and i != j:
            tops = reduce(np.maximum, (sims.max(axis=0, keepdims=True) for _, sims in slices()))
        for at, sims in slices():
            yield from found(sims, at, None if epsilon is None else sims.max(axis=1, keepdims=True), False).to_batches()
            if i != j:
                yield from found(sims, at, tops, True).to_batches()

    return dealt.groupBy("i", "j").applyInArrow(pairs, made)


def block_pairs(objects: DataFrame, threshold: float, ident: str, vector: str, block_rows: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """i, j, block, id, v (and what to carry): the rows of each pair (i, j) of blocks that may hold a pair of objects at the threshold or above."""
    rows = objects.filter(F.size(vector) > 0).select(F.col(ident).alias("id"), F.col(vector).alias("v"), *carry)
    n = rows.count()
    if n <= block_rows:
        zero = F.lit(0).cast("long")
        return rows.select(zero.alias("i"), zero.alias("j"), zero.alias("block"), "id", "v", *carry)
    placed, centres = make_cells(rows, block_rows, n)
    pairs = materialize(near_cell_pairs(cell_table(placed), centres, threshold), "block-pairs")
    met = pairs.select("i", "j", F.col("i").alias("block")).unionByName(pairs.filter("i <> j").select("i", "j", F.col("j").alias("block")))
    return placed.select(F.col("cell").alias("block"), "id", "v", *carry).join(met, "block").select("i", "j", "block", "id", "v", *carry)


def nearest(objects: DataFrame, registry: DataFrame, threshold: float = THRESHOLD, k: int = CANDIDATES, ident: str = "id", ref: str = "id", vector: str = "embedding", block_rows: int = CELL_ROWS) -> DataFrame:
    """src, ref, similarity: for each object the k rows of the registry with the largest cosine above (not at) the threshold, ties to the smaller ref. An index of the registry is made for this search; one that is stored is searched by
    vector_index.search()."""
    made = vector_index.make_segment(registry, ref, vector, block_rows)
    return vector_index.search(_usable(objects, ident, vector), [made], threshold, k)


def near_top(pairs: DataFrame, threshold: float = THRESHOLD, epsilon: float = EPSILON, by: tuple[str, ...] = ("src",)) -> DataFrame:
    """Of each object's pairs those within epsilon of its best, and at the threshold or above."""
    top = F.max("similarity").over(Window.partitionBy(*by))
    return pairs.withColumn("__top", top).filter((F.col("similarity") >= F.greatest(F.lit(threshold), F.col("__top") - epsilon))).drop("__top")


def candidates(objects: DataFrame, registry: DataFrame | list[vector_index.Segment], threshold: float = THRESHOLD, epsilon: float = EPSILON, k: int = CANDIDATES, ident: str = "id", ref: str = "id", vector: str = "embedding") -> DataFrame:
    """src, dst (another object) or ref (a row of the registry, given as rows or by its index), similarity and is_from_input_list: what a verifier should look at. The window below the best is taken for either kind apart."""
    own = near_top(self_pairs(objects, threshold, ident, vector, epsilon=epsilon), threshold, epsilon)
    index = registry if isinstance(registry, list) else [vector_index.make_segment(registry, ref, vector)]
    stored = near_top(vector_index.search(_usable(objects, ident, vector), index, threshold, k), threshold, epsilon)
    return both_kinds(own, stored)


def both_kinds(own: DataFrame, stored: DataFrame) -> DataFrame:
    """Pairs of objects (src, dst) and of objects with rows of the registry (src, ref) under one schema, told apart by is_from_input_list."""
    own_kind, ref_kind = own.schema["dst"].dataType, stored.schema["ref"].dataType
    return own.select("src", "dst", F.lit(None).cast(ref_kind).alias("ref"), "similarity", F.lit(True).alias("is_from_input_list")).unionByName(
        stored.select("src", F.lit(None).cast(own_kind).alias("dst"), "ref", "similarity", F.lit(False).alias("is_from_input_list"))
    )
