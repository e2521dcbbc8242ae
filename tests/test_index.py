"""Cells with bounds: searches and self-joins equal to brute force that open fewer cells than there are."""

import numpy as np
import pytest

from weftgraph.operators import cells, similarity, vector_index


def unit(v):
    v = np.asarray(v, float)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-10)


def grouped(seed, n, dims=16, groups=12, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dims))


def scattered(seed, n, dims=16):
    return np.random.default_rng(seed).normal(size=(n, dims))


def frame(spark, v, ids=None):
    return spark.createDataFrame([(i, None if x is None else [float(a) for a in x]) for i, x in zip(range(len(v)) if ids is None else ids, v, strict=True)], "id long, embedding array<float>")


def brute(queries, rows, threshold, k):
    sims = unit(np.asarray(queries, np.float32)) @ unit(np.asarray(rows, np.float32)).T
    out = set()
    for i, s in enumerate(sims):
        out |= {(i, j) for j in sorted(range(len(s)), key=lambda j: (-s[j], j))[:k] if s[j] > threshold}
    return out


@pytest.mark.parametrize("make, threshold, k", [(grouped, 0.5, 3), (scattered, 0.2, 5), (grouped, 0.9, 50)])
def test_search_equals_brute_force(spark, make, threshold, k):
    rows, queries = make(1, 600), make(2, 40)
    rows[50:80] = rows[50]  # equal vectors: ties by id, more of them than a cell holds
    found, opened = vector_index.search_counted(frame(spark, queries).withColumnRenamed("embedding", "v"), [vector_index.make_segment(frame(spark, rows), cell_rows=20)], threshold, k)
    got = {(r["src"], r["ref"]) for r in found.collect()}
    assert got == brute(queries, rows, threshold, k)
    if make is grouped:  # all cells of all queries would be over 30 * 40
        assert opened.count() < 40 * 30 / 3
    assert opened.distinct().count() == opened.count()


def test_search_over_segments_and_odd_rows(spark):
    a, b, queries = grouped(1, 100), grouped(3, 70), grouped(2, 9)
    ids = list(range(100, 170))
    segments = [vector_index.make_segment(frame(spark, list(a) + [None, []], [*range(100), 900, 901]), cell_rows=16), vector_index.make_segment(frame(spark, b, ids), cell_rows=16), vector_index.make_segment(frame(spark, []))]
    asked = frame(spark, queries).withColumnRenamed("embedding", "v")
    got = {(r["src"], r["ref"]) for r in vector_index.search(asked, segments, 0.3, 4).collect()}
    assert got == brute(queries, np.r_[a, b], 0.3, 4)
    assert vector_index.search(asked, [segments[2]], 0.3, 4).count() == 0
    assert vector_index.search(asked.limit(0), segments, 0.3, 4).count() == 0


@pytest.mark.parametrize("make, threshold", [(grouped, 0.8), (scattered, 0.4)])
def test_self_pairs_equal_brute_force(spark, make, threshold):
    v = make(5, 300)
    v[100:140] = v[100]
    objects = frame(spark, v)
    sims = unit(np.asarray(v, np.float32)) @ unit(np.asarray(v, np.float32)).T
    np.fill_diagonal(sims, -1)
    pairs = similarity.self_pairs(objects, threshold, block_rows=20).collect()
    assert {(r["src"], r["dst"]) for r in pairs} == set(zip(*map(np.ndarray.tolist, np.nonzero(sims >= threshold)), strict=True)) and len(pairs) == (sims >= threshold).sum()
    near = similarity.near_top(similarity.self_pairs(objects, threshold, block_rows=20, epsilon=0.05), threshold, 0.05)
    best = np.maximum(sims.max(1, keepdims=True) - 0.05, threshold)
    assert {(r["src"], r["dst"]) for r in near.collect()} == set(zip(*map(np.ndarray.tolist, np.nonzero(sims >= best)), strict=True))
    placed, centres = cells.make_cells(objects.withColumnRenamed("embedding", "v"), 20)
    table = cells.cell_table(placed)
    n, made = table.count(), cells.near_cell_pairs(table, centres, threshold).count()
    assert table.agg({"n": "max"}).first()[0] <= 20
    if make is grouped:  # blocks that can't hold a pair never meet
        assert made < n * (n + 1) / 2 / 3


def test_bounds_hold():
    rng = np.random.default_rng(7)
    for dims in (2, 3, 30):
        v, c, q, d = (unit(rng.normal(size=(m, dims))) for m in (50, 1, 20, 1))
        v[0] = 0
        off = cells.angles(c, v)[0]
        near = cells.least_angle(cells.angles(q, c)[:, 0], off.min(), off.max())
        assert (cells.angles(q, v).min(1) >= near).all()
        other = cells.angles(d, q)[0]
        assert cells.angles(v, q).min() >= cells.least_angle_of_cells(cells.angles(c, d)[0, 0], off.min(), off.max(), other.min(), other.max())
