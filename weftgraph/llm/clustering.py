"""Centroid clustering by exponion search, exact in integers.

Each vector carries a bound from above of its distance to its centroid a, and one from below of that to any other. Where the first is below the second, or below half the distance from a to the centroid next to it,
nothing can have changed. Else the nearest and the second nearest centroids stand no further from a than twice the vector's distance to a and the distance from a to the centroid next to it: only those are looked at, in the
order of a list of centroids sorted by their distance from a. The radius is inclusive and the tests strict, so that ties are seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import materialize, scratch
from weftgraph.plans.staging import discard

DIMENSIONS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Components beyond this, after scaling, have squared distances that a long can't hold.
MOST = 1 << 27
#: Bounds are widened by this share, for what floating point loses.
SLACK = 1e-9


def usable(vector: Column, dimensions: int = DIMENSIONS, scale: int = SCALE) -> Column:
    """Whether a vector has the right number of components, none of them null, non-finite or beyond MOST once scaled."""
    fits = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) * scale < MOST))  # false for NaN, which is larger than all
    return F.coalesce((F.size(vector) == dimensions) & fits, F.lit(False))


def scaled(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))


class Centroids:
    """Centroids as integers, with the distances between them, for each the others from near to far."""

    def __init__(self, vectors: np.ndarray, shifts: np.ndarray | None = None) -> None:
        self.v = vectors.astype(np.int64)
        k = len(self.v)
        #: How far each has moved since the last round (None: bounds of the last round are none).
        self.shifts = shifts
        d = np.sqrt(np.stack([squared(self.v, np.full(k, j), self.v) for j in range(k)], 1).astype(np.float64)) if k else np.zeros((0, 0))
        np.fill_diagonal(d, -1)
        self.order = np.argsort(d, axis=1, kind="stable")[:, 1:]
        self.far = np.take_along_axis(d, self.order, 1)
        #: Distance to the next one; without another, no other is ever near.
        self.next = self.far[:, 0] if k > 1 else np.full(k, np.inf)


def squared(x: np.ndarray, which: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to the centroids of the given numbers, exactly."""
    gap = x - centroids[which]
    return np.einsum("ij,ij->i", gap, gap)


def assign(x: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """For integer vectors x with a centroid of the last round and bounds: the nearest centroid (of equal ones the smaller number), its squared distance, the new bounds, and how many distances were worked out."""
    near = near.astype(np.int64).copy()
    if c.shifts is not None:
        upper = (upper + c.shifts[near]) * (1 + SLACK)
        most, at = c.shifts.max(), c.shifts.argmax()
        rest = np.delete(c.shifts, at).max(initial=0)
        lower = (lower - np.where(near == at, rest, most)) * (1 - SLACK) - SLACK
    dist = squared(x, near, c.v)
    u = np.sqrt(dist.astype(np.float64))
    worked = len(x)
    lower = np.maximum(lower, c.next[near] / 2 * (1 - SLACK)) if c.shifts is not None else np.zeros(len(x))
    # the bound from above says who needn't be looked at; the distance itself is needed for the result
    open_ = np.flatnonzero((np.minimum(upper, u * (1 + SLACK)) >= lower) if c.shifts is not None else np.ones(len(x), bool))
    if len(open_) and len(c.v) > 1:
        best, first = dist[open_].copy(), near[open_].copy()
        second = np.full(len(open_), np.iinfo(np.int64).max)
        radius = (2 * u[open_] + c.next[first]) * (1 + SLACK) + SLACK
        start = first.copy()
        for a in np.unique(start).tolist():
            mine = np.flatnonzero(start == a)
            upto = np.searchsorted(c.far[a], radius[mine], side="right")  # inclusive
            by_reach = mine[np.argsort(-upto, kind="stable")]
            reach = np.sort(upto)[::-1]
            for place in range(int(reach[0])):
                some = by_reach[: np.searchsorted(-reach, -place, side="left")]
                j = int(c.order[a, place])
                d = squared(x[open_[some]], np.full(len(some), j), c.v)
                worked += len(some)
                wins = (d < best[some]) | ((d == best[some]) & (j < first[some]))
                second[some] = np.minimum(second[some], np.where(wins, best[some], d))
                best[some] = np.where(wins, d, best[some])
                first[some] = np.where(wins, j, first[some])
        near[open_], dist[open_] = first, best
        u[open_] = np.sqrt(best.astype(np.float64))
        lower[open_] = np.sqrt(second.astype(np.float64)) * (1 - SLACK)
    elif len(c.v) == 1:
        lower = np.full(len(x), np.inf)
    return near, dist, u * (1 + SLACK), lower, worked


def _round(rows: DataFrame, centroids: Centroids) -> DataFrame:
    known = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if not len(df):
                continue
            x = np.stack(df["v"].to_numpy()).astype(np.int64)
            near, dist, upper, lower, worked = assign(x, df["cluster"].to_numpy(), df["upper"].to_numpy(), df["lower"].to_numpy(), known.value)
            yield df.assign(cluster=near.astype(np.int32), distance=dist, upper=upper, lower=lower, worked=np.r_[np.int64(worked), np.zeros(len(df) - 1, np.int64)])

    return rows.mapInPandas(run, rows.schema)


def seeds(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The first k vectors by the hash of seed and id; of equal hashes the smaller vector first, null ids last. At most k rows reach the driver."""
    found = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)).orderBy(F.asc_nulls_last("h"), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in found], np.int64)


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 for each vector, and worked: the distances worked out in the last assignment, told in one row of each batch.

    A component x counts as floor(scale * x). Centroids start as the k vectors first by the hash of `seed:id`. Each round assigns every vector to the nearest centroid (squared distance; ties: the smaller number), then puts
    every centroid that has vectors at the floor of their mean; then vectors are assigned once more. All sums are of integers, so the result doesn't hang on how rows are dealt out.

    Vectors that are null, of another length, or hold nulls or non-finite components take no part; nor do those with a component of 2^27 or more once scaled, as a long can't hold their distances. Fewer than k vectors make as many
    centroids; without any there are no rows. Rows that repeat an id are vectors of their own; null ids take part, and are seeds last. Equal vectors among the seeds make equal centroids, of which the later ones get nothing and stay.
    Other columns are not returned. The driver and a broadcast hold k centroids; a cluster that has most of the rows is summed in parts like any other.
    """
    spark = vectors.sparkSession
    with scratch(spark):
        kept = vectors.filter(usable(F.col(vector_col), dimensions, scale)).select(F.col(id_col).alias("id"), scaled(F.col(vector_col), scale).alias("v"))
        start = kept.withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long"), "upper": F.lit(0.0), "lower": F.lit(0.0), "worked": F.lit(0).cast("long")})
        state = materialize(start, "vectors")
        centroids = seeds(state, k, seed)
        shifts = None
        for _ in range(rounds if len(centroids) else 0):
            before, state = state, materialize(_round(state, Centroids(centroids, shifts)), "assigned")
            discard(before)
            moved = _means(state, centroids)
            gap = (moved - centroids).astype(np.float64)
            shifts = np.sqrt((gap * gap).sum(1)) * (1 + SLACK)
            centroids = moved
        if len(centroids):
            before, state = state, materialize(_round(state, Centroids(centroids, shifts)), "clustered", keep=True)
            discard(before)
        else:
            state = materialize(state, "clustered", keep=True)
        sums = state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()
        by_cluster, total = {r["cluster"]: r["s"] for r in sums}, sum(r["s"] for r in sums)
        told = [(j, by_cluster.get(j, 0), total, ",".join(map(str, c))) for j, c in enumerate(centroids.tolist())]
        about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, components string").withColumn("centroid_sha256", F.sha2("components", 256)).drop("components")
        return state.join(F.broadcast(about), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "worked")


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids at the floor of the mean of their vectors; those without vectors stay. Sums are made in parts before they are shuffled; the driver sees a row for each centroid."""
    n = centroids.shape[1]
    sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("v")[i]) for i in range(n)]).alias("s")).collect()
    out = centroids.copy()
    for r in sums:
        out[r["cluster"]] = [s // r["n"] for s in r["s"]]
    return out


def _oracle(k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    distance = "list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))"
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, x.v AS v, min((d, c)) AS m FROM (SELECT x.vec_id, x.v, c.c, CAST({distance} AS BIGINT) AS d FROM kept x, c{r} c) x GROUP BY vec_id, x.v)")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT c, list(m ORDER BY i) AS v FROM (SELECT a.m[2] AS c, i, CAST(floor(sum(a.v[i]) / count(*)) AS BIGINT) AS m FROM a{r} a, range(1, {DIMENSIONS + 1}) t(i) GROUP BY ALL) GROUP BY c),
            c{r + 1} AS MATERIALIZED (SELECT c{r}.c AS c, coalesce(s{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN s{r} ON s{r}.c = c{r}.c)""")
    last = f"SELECT a.vec_id, CAST(a.m[2] AS INTEGER) AS cluster, a.m[1] AS distance, CAST(sum(a.m[1]) OVER (PARTITION BY a.m[2]) AS BIGINT) AS cluster_inertia, CAST(sum(a.m[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.c = a.m[2]"
    return "WITH " + ",\n".join(steps) + "\n" + last


#: What the query returns, without `worked`.
ORACLE_SQL = _oracle()
