import pytest
from pyspark.sql import functions as F

from weftgraph.operators import similarity
from weftgraph.operators.resolution import resolve

VERIFIED = "src string, dst string, ref long, are_same boolean, updated_name string, updated_description string, seq int"


def run(spark, mode):
    objects = spark.createDataFrame([("a", "Augustus", "d"), ("b", "Octavian", "e"), ("c", "Rome", "f"), ("x", "Carthage", "g")], "hash string, name string, description string")
    verified = spark.createDataFrame([("a", "b", None, True, "Gaius Augustus", None, 1), ("b", "a", None, True, None, "", 2), ("c", None, 7, True, None, None, 3), ("x", "c", None, False, None, None, 4)], VERIFIED)
    registry = spark.createDataFrame([(7, "Roma"), (9, "Carthage"), (8, "Carthage")], "id long, name string")
    resolved, new = resolve(objects, verified, registry, mode)
    return {r["hash"]: (r["component"], r["reference"], r["is_new"]) for r in resolved.collect()}, {r["component"]: r["name"] for r in new.collect()}


def test_a_verified_row_of_the_registry_is_linked(spark):
    resolved, new = run(spark, "verified")
    assert resolved == {"a": ("a", None, True), "b": ("a", None, True), "c": ("c", 7, True), "x": ("x", 8, True)}
    assert new == {"a": "Gaius Augustus"}


def test_by_name_only_it_is_not(spark):
    resolved, new = run(spark, "name_only")
    assert resolved["c"] == ("c", None, True) and new == {"a": "Gaius Augustus", "c": "Rome"}


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        run(spark, "other")


def test_similarity_in_blocks_is_that_of_one_block(spark):
    rows = spark.range(60).select("id", F.array(*[F.sin(F.col("id") * k).cast("float") for k in range(1, 9)]).alias("embedding")).unionByName(spark.createDataFrame([(60, []), (61, None)], "id long, embedding array<float>"))
    pairs = lambda n: {(r["src"], r["dst"]): round(r["similarity"], 9) for r in similarity.self_pairs(rows, 0.2, block_rows=n).collect()}
    assert pairs(7) == pairs(1000) and len(pairs(7)) > 50
    near = lambda n: sorted((r["src"], r["ref"]) for r in similarity.nearest(rows, rows, 0.2, 3, block_rows=n).collect())
    assert near(7) == near(1000)


def test_threshold_is_reached_by_inputs_and_passed_by_the_registry(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "id long, embedding array<float>")
    assert similarity.self_pairs(rows, 1.0).count() == 2
    assert similarity.nearest(rows, rows, 1.0).count() == 0


def test_window_below_the_best(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.86), (1, 4, 0.8), (2, 3, 0.41)], "src int, dst int, similarity double")
    assert {(r["src"], r["dst"]) for r in similarity.near_top(pairs).collect()} == {(1, 2), (1, 3), (2, 3)}


def test_blocks_keep_what_is_near_their_best(spark):
    import numpy as np

    from weftgraph.operators import similarity

    rng = np.random.default_rng(3)
    m = rng.standard_normal((200, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<double>")
    wanted = similarity.near_top(similarity.self_pairs(rows, 0.4, block_rows=40), 0.4, 0.05)
    few = similarity.self_pairs(rows, 0.4, block_rows=40, epsilon=0.05)
    ids = lambda df: sorted((r["src"], r["dst"]) for r in df.collect())
    assert ids(similarity.near_top(few, 0.4, 0.05)) == ids(wanted) and few.count() < similarity.self_pairs(rows, 0.4).count()
