"""Approximate nearest neighbours: a forest of random-projection trees, searched through one priority queue for all trees, then exact scores."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import bound_batches

TREES = 16
LEAF_ROWS = 400
#: A search opens EFFORT * cells ** GROWTH cells.
EFFORT, GROWTH = 0.45, 0.7
#: Rows that the hyperplanes are fitted on, at most; every row is indexed.
SAMPLE_ROWS = 16_384
#: Rows of a leaf that one group holds; larger leaves are dealt over several.
CHUNK_ROWS = 1_024
#: Queries whose best a task keeps before it hands them on.
HELD_QUERIES = 20_000


class Forest:
    """Perfect binary trees of hyperplanes, each through the median of its node's sample rows; node v has the children 2v + 1 and 2v + 2. Cell t * leaves + l is leaf l of tree t."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.trees, self.depth, self.leaves = trees, depth, 2**depth
        self.inner = self.leaves - 1
        dims = sample.shape[1]
        self.normals = np.zeros((trees, self.inner, dims))
        self.cuts = np.zeros((trees, self.inner))
        for t in range(trees):
            members = {0: np.arange(len(sample))}
            for v in range(self.inner):
                own = members.pop(v)
                pair = sample[own[rng.integers(0, len(own), 2)]] if len(own) else np.zeros((2, dims))
                normal = pair[0] - pair[1]
                if not np.linalg.norm(normal) > 1e-9:
                    normal = rng.standard_normal(dims)
                normal /= np.linalg.norm(normal)
                at = sample[own] @ normal
                cut = float(np.median(at)) if len(own) else 0.0
                self.normals[t, v], self.cuts[t, v] = normal, cut
                members[2 * v + 1], members[2 * v + 2] = own[at <= cut], own[at > cut]

    def cells_of(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector in each tree."""
        out = np.zeros((len(vectors), self.trees), np.int64)
        for t in range(self.trees):
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                above = (vectors * self.normals[t, node]).sum(axis=1) > self.cuts[t, node]
                node = 2 * node + 1 + above
            out[:, t] = t * self.leaves + node - self.inner
        return out

    def search(self, query: np.ndarray, counts: np.ndarray, visits: int, least: int) -> list[int]:
        """The first `visits` cells by the largest margin that a path to them crosses, over all trees together; more until some tree has given `least` rows."""
        margins = self.normals @ query - self.cuts  # trees x inner nodes
        queue = [(0.0, t, 0) for t in range(self.trees)]
        cells, rows = [], np.zeros(self.trees, np.int64)
        while queue and (len(cells) < visits or rows.max() < least):
            far, t, v = heapq.heappop(queue)
            while v < self.inner:
                m = margins[t, v]
                near = 2 * v + 1 + (m > 0)
                heapq.heappush(queue, (max(far, abs(m)), t, 4 * v + 3 - near))
                v = near
            cell = t * self.leaves + v - self.inner
            rows[t] += counts[cell]
            cells.append(cell)
        return cells


def _valid(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.float64).reshape(len(vectors), -1)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(ids) > 4 * k:
        worst = -np.partition(-scores, k - 1)[k - 1]
        some = np.flatnonzero(scores >= worst)
    else:
        some = np.arange(len(ids))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, leaf_rows: int = LEAF_ROWS, effort: float = EFFORT, growth: float = GROWTH, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `is_query` the k other rows of largest inner product among those in the cells that its search reaches.

    Trees are fitted on at most sample_rows rows (those of smallest id hash) and have leaves of about leaf_rows rows, if the sample allows; a search opens
    effort * cells ** growth cells. Each cell's rows, in chunks of about CHUNK_ROWS, meet the queries that opened it in one place, as a block product; of each query, a task passes on its
    best k. Scores are sums of products of doubles, made anew for these. For tables of up to leaf_rows rows the result is exact.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do those with a length other than the commonest (the larger one, if two are equally common) or a null id. Ids are whole numbers; a column of another type is an error.
    Rows that repeat an id count as one, with the larger score. Ties go to the smaller id. Equal vectors fall into one leaf, which is dealt over as many chunks as it needs.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    if vectors.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col} must be of whole numbers")
    out_schema = f"query_id long, rank int, {id_col} long, score double"
    taken = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q")).filter(F.col("id").isNotNull() & _valid(F.col("v")))
    sizes = taken.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if sizes is None:
        return spark.createDataFrame([], out_schema)
    dims, n = sizes["dims"], sizes["count"]
    taken = taken.filter(F.size("v") == dims)
    sample = _matrix(taken.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toPandas()["v"])
    depth = max(0, min(round(log2(n / leaf_rows)), int(log2(max(len(sample) / 8, 1)))))
    forest = spark.sparkContext.broadcast(Forest(sample, trees, depth))

    @F.pandas_udf("array<int>")
    def cells_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series(list(forest.value.cells_of(_matrix(v)).astype(np.int32))) if len(v) else pd.Series([], dtype=object)

    placed = taken.withColumn("cell", F.explode(cells_of("v")))
    counts = np.zeros(trees * 2**depth, np.int64)
    for r in placed.groupBy("cell").count().collect():  # at most a row for each cell
        counts[r["cell"]] = r["count"]
    chunks = np.maximum(1, -(-counts // CHUNK_ROWS))
    visits = ceil(effort * (trees * 2**depth) ** growth)

    @F.pandas_udf("array<int>")
    def opened(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series([np.array(forest.value.search(x, counts, visits, 4 * k), np.int32) for x in _matrix(v)], dtype=object)

    chunks_of = F.element_at(F.array(*[F.lit(int(c)) for c in chunks]), F.col("cell") + 1) if (chunks > 1).any() else F.lit(1)
    rows = placed.withColumn("chunk", F.pmod(F.xxhash64("id"), chunks_of).cast("int")).select("cell", "chunk", F.lit(False).alias("asks"), "id", "v")
    asks = taken.filter(F.col("q")).withColumn("cell", F.explode(opened("v"))).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks_of - 1))).select("cell", "chunk", F.lit(True).alias("asks"), "id", "v")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list] = {}  # query -> its vector, ids, scores
        at, ids, block = None, [], []

        def results() -> pd.DataFrame:
            out = []
            for q, (own, found, vecs, _) in best.items():
                exact = (vecs * own).sum(axis=1)
                out.append(pd.DataFrame({"query_id": q, "vec_id": found, "score": exact}))
            best.clear()
            return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

        for df in batches:
            for (cell, chunk, is_ask), g in df.groupby(["cell", "chunk", "asks"], sort=True):
                if (cell, chunk) != at:
                    at, ids, block = (cell, chunk), [], []
                if not is_ask:
                    ids.append(g["id"].to_numpy())
                    block.append(_matrix(g["v"]))
                    continue
                if not ids:
                    continue
                ids, block = [np.concatenate(ids)], [np.concatenate(block)]
                asked, q = _matrix(g["v"]), g["id"].to_numpy()
                # equal vectors get equal scores: products of a block may differ in the last digits
                scores = np.round(asked @ block[0].T, 13)
                for i, (query, own) in enumerate(zip(q.tolist(), asked, strict=True)):
                    row = np.where(ids[0] == query, -np.inf, scores[i])
                    top = _best(ids[0], row, k)
                    top = top[np.isfinite(row[top])]
                    found, vecs, s = ids[0][top], block[0][top], row[top]
                    if query in best:
                        _, f0, v0, s0 = best[query]
                        found, vecs, s = np.concatenate([f0, found]), np.concatenate([v0, vecs]), np.concatenate([s0, s])
                        order = np.lexsort((-s, found))
                        once = order[np.r_[True, found[order][1:] != found[order][:-1]]] if len(order) else order
                        keep = once[_best(found[once], s[once], k)]
                        found, vecs, s = found[keep], vecs[keep], s[keep]
                    best[query] = [own, found, vecs, s]
                if len(best) > HELD_QUERIES:
                    yield results()
        yield results()

    together = rows.unionByName(asks).repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "asks")
    met = together.mapInPandas(meet, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), F.col("vec_id").alias(id_col), "score")
