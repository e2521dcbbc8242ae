"""What queries over the star schema move, by their plans."""

import random
import re

import pytest

from weftgraph import queries
from weftgraph.operators import resolution, similarity, triples

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("objects", [triples.entities, triples.relationship_types])
def test_objects_are_made_distinct_before_they_are_sorted(spark, objects):
    """A minimum of strings is found by sorting; the triples themselves are not sorted for it."""
    rows = spark.createDataFrame([("a", "x", "b", "y", "r", "z")] * 3, "from_entity string, from_entity_description string, to_entity string, to_entity_description string, relationship_type string, relationship_description string")
    found = objects(triples.with_hashes(rows))
    steps = [line for line in plan(found).splitlines() if re.search(r"\w*Aggregate\(|\bSort \[", line)]
    assert "HashAggregate(" in steps[-1] and "HashAggregate(" in steps[-2]
    assert found.count() == (2 if objects is triples.entities else 1)


def test_references_are_looked_up_before_triples_are_made(no_broadcast):
    """Triples, one for each pair of a supplier and a part, move by keys, not by the hashes of their ends."""
    linked = plan(queries.Q["link_references"](no_broadcast, SF))
    assert not re.search(r"(Join|Exchange)[^\n]*(from|to)_entity_hash", linked)
    # one move of lineitem both makes its pairs distinct and brings them to their parts
    assert len(re.findall(r"Exchange hashpartitioning\(l_partkey", linked)) == 1 and not re.search(r"Exchange hashpartitioning\(l_suppkey#\w+, l_partkey", linked)


@pytest.mark.parametrize("name", ["verify_merge", "connected_components"])
def test_pairs_are_not_joined_to_their_ends(no_broadcast, name):
    """Pairs grow as the square of the objects: labels come with them, and answers stay with them."""
    made = queries._same(no_broadcast, SF) if name == "connected_components" else queries.Q[name](no_broadcast, SF)
    assert "Join" not in plan(made)


def test_pairs_leave_in_slices(spark, monkeypatch):
    """Whatever the slices of a product, pairs are the same, with what is carried, of ids of any type."""
    rng = random.Random(4)
    rows = [(f"k{i}", [rng.gauss(0, 1) for _ in range(4)], i % 3) for i in range(60)]
    objects = spark.createDataFrame(rows, "id string, embedding array<float>, g int")
    names, seen = {r[0]: r[2] for r in rows}, []
    for cells, block in ((1 << 22, 1_000), (70, 1_000), (70, 16)):
        monkeypatch.setattr(similarity, "SLICE_CELLS", cells)
        for epsilon in (None, 0.05):
            found = similarity.self_pairs(objects, 0.3, block_rows=block, epsilon=epsilon, carry=("g",))
            if epsilon:
                found = similarity.near_top(found, 0.3, epsilon)
            got = found.collect()
            assert all((r["src_g"], r["dst_g"]) == (names[r["src"]], names[r["dst"]]) for r in got)
            seen.append({(r["src"], r["dst"]): round(r["similarity"], 9) for r in got})
            assert len(seen[-1]) == len(got) > 0
    assert seen[0] == seen[2] == seen[4] and seen[1] == seen[3] == seen[5]


def test_answers_beside_pairs_or_in_a_table(spark):
    pairs = spark.createDataFrame([(0, i, i + 1) for i in range(4)], "batch_no int, pair_id int, dst int")
    told = spark.createDataFrame([(0, 0, True, "a", ""), (0, 1, False, "b", "c"), (0, 9, True, "stray", "")], "batch_no int, pair_id int, are_same boolean, updated_name string, updated_description string")
    asked = resolution.merge_verdicts(pairs, told)
    beside = resolution.merge_verdicts(pairs.join(told, ["batch_no", "pair_id"], "left"))
    assert sorted(asked.collect()) == sorted(beside.collect()) and asked.filter("are_same").count() == 1 and asked.count() == 4
