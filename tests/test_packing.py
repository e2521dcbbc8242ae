import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.operators import batching
from weftgraph.operators.batching import embedding_batches, next_fit, verification_batches
from weftgraph.operators.chunking import chunk_documents, pack
from weftgraph.operators.numbering import number_rows

WORDS = lambda t: len(t.split())


def test_chunks_of_each_kind():
    text = "one two\n\nthree four five. six seven. eight nine ten eleven twelve.\n\nlast"
    found = pack(text, 4, WORDS)
    assert [c[0] for c in found] == ["one two", "three four five.", "six seven.", "eight nine ten eleven", "twelve.", "last"]
    for joined, start, end, _, _ in found:
        assert text[start:end].split() == joined.split()


def test_exact_fit_stays_and_empty_texts_give_nothing():
    assert [c[0] for c in pack("a b\n\nc d", 4, WORDS)] == ["a b c d"]
    assert pack("", 4, WORDS) == [] and len(pack("", 4, WORDS, keep_empty=True)) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb.", "c!", "\n\n", "d e f g h", " ", "longword"]), max_size=40), st.integers(1, 6))
def test_chunks_keep_all_words_in_order_within_budget(parts, budget):
    text = " ".join(parts)
    found = pack(text, budget, WORDS)
    assert " ".join(c[0] for c in found).split() == text.split()
    assert all(WORDS(c[0]) <= budget for c in found)


def test_chunk_documents(spark):
    docs = spark.createDataFrame([("u", "a b. c d."), ("v", None), ("w", "")], "uri string, content string")
    rows = chunk_documents(docs, 2).orderBy("uri", "chunk_no").select("uri", "chunk_no", "chunk").collect()
    assert [tuple(r) for r in rows] == [("u", 0, "a b."), ("u", 1, "c d.")]


def model(costs, budget, reserve, guard):
    batch, used, n, out = 0, 0, 0, []
    for c in costs:
        if used + c + reserve > budget and (n or not guard):
            batch, used, n = batch + 1, 0, 0
        used, n = used + c, n + 1
        out.append(batch)
    return out


def test_next_fit_is_that_of_a_loop(spark):
    costs = [10, 3000, 600, 5000, 1, 3499, 1, 3500, 500, 0, 4000]
    rows = spark.createDataFrame(list(enumerate(costs)), "seq int, cost int")
    got = [r["batch_no"] for r in verification_batches(rows, "cost", order=["seq"]).orderBy("seq").collect()]
    assert got == model(costs, 4000, 500, True)
    got = [r["batch_no"] for r in next_fit(rows, "cost", 4000, 0, ["seq"], guard_empty=False).orderBy("seq").collect()]
    assert got == model(costs, 4000, 0, False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=12), min_size=1, max_size=6), st.integers(1, 14), st.integers(0, 14))
def test_maps_of_ranges_join(ranges, room, used):
    """What joined maps say of an open batch is what a loop over all rows finds."""
    maps = [batching.range_map(np.array(r, np.int64), room) for r in ranges]
    whole = batching.joined_maps(maps, room)
    one = batching.range_map(np.array([c for r in ranges for c in r], np.int64), room)
    for m in (whole, one):
        after, n = batching._follow(np.array([used]), np.array([0]), m, room)
        u, k = used, 0
        for c in (c for r in ranges for c in r):
            u, k = (c, k + 1) if u + c > room else (u + c, k)
        assert (after[0], n[0]) == (u, k)


@pytest.mark.parametrize("cost, room, fan", [(1, 7, 2), (1, 1_000, 2), (None, 50, 3), (None, 9, 16)])
def test_batches_go_on_over_many_ranges(spark, monkeypatch, cost, room, fan):
    """As a loop over all rows, also where costs are all 1 and maps are long; the driver gets a row for each range."""
    monkeypatch.setattr(batching, "FAN", fan)
    rng = random.Random(6)
    costs = [cost or rng.choice([0, 1, 2, 5, 9, 60]) for _ in range(900)]
    rows = spark.createDataFrame([(i, c, "x") for i, c in enumerate(costs)], "seq int, cost int, before string").repartition(3)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    for k, v in zip(before, ("13", "false", "20"), strict=True):
        spark.conf.set(k, v)
    got = []
    collect = type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda self: got.append(collect(self)) or got[-1])
    try:
        done = next_fit(rows, "cost", room + 3, 3, ["seq"])
        assert done.columns == ["seq", "cost", "before", "batch_no"]
        monkeypatch.undo()
        assert len(got) == 2 and all(len(x) <= 13 for x in got)
        assert [r["batch_no"] for r in done.orderBy("seq").collect()] == model(costs, room + 3, 3, True)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_nothing_makes_no_batches(spark):
    assert next_fit(spark.range(0).withColumn("cost", F.lit(1)), "cost", 5, 0, ["id"]).count() == 0


def test_embedding_batches_below_the_limit_are_one(spark):
    rows = spark.createDataFrame([(1, 50), (2, 60)], "seq int, cost int")
    assert {r["batch_no"] for r in embedding_batches(rows, "cost", 110, ["seq"]).collect()} == {0}
    assert {r["batch_no"] for r in embedding_batches(rows, "cost", 100, ["seq"]).collect()} == {0, 1}


def test_segments_pack_apart(spark):
    rows = spark.range(10).withColumn("cost", F.lit(1))
    got = next_fit(rows, "cost", 3, 0, ["id"], segment_rows=4).orderBy("id").collect()
    assert [(r["segment"], r["batch_no"]) for r in got] == [(0, 0), (0, 0), (0, 0), (0, 1), (1, 0), (1, 0), (1, 0), (1, 1), (2, 0), (2, 0)]


def test_numbers_have_no_gaps(spark):
    rows = spark.range(1000).repartition(7).withColumn("key", F.pmod(F.col("id") * 7919, F.lit(1009)))
    got = number_rows(rows, ["key"]).orderBy("key").collect()
    assert [r["row_no"] for r in got] == list(range(1000))
