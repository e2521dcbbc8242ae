"""What a Python worker holds, as it stands beside a JVM and other workers in an executor's memory."""

import tracemalloc

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
import zstandard
from pyspark.sql import functions as F

from tests.llm.test_texts import PATH
from weftgraph.llm import byte_bpe, passages, quality, substring_dedup


def test_an_encoder_is_small_and_made_without_much_more():
    """With tuples for each merge, and tables that few texts need, it held 93 MB and took 156 MB to make."""
    with open(PATH, "rb") as f:
        data = f.read()
    tracemalloc.start()
    try:
        encoder = byte_bpe.Encoder(byte_bpe.read_ranks(data), public_tokenizers.PATTERN, 0.25)
        encoder.encode_all(["Some words of a text, and others."])
        held, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert held < 60e6 and most < 75e6


def test_what_is_made_late_gives_the_same_ids():
    """Long pieces, which need the tables that are made late, and letters of which Python and the pattern think differently."""
    with open(PATH, "rb") as f:
        ranks = byte_bpe.read_ranks(f.read())
    encoder = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN, 0.25)
    assert not {"kinds", "_ends"} & set(vars(encoder.transducer))
    reference = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["extraordinarilyinterconnectedrepresentations" * 3 + " and more", "ⓐⓑ Ⅷ ª x² word word  　end", "extraordinarilyinterconnectedrepresentations" * 3]
    for _ in range(3):  # transitions enter when they are needed again
        assert [list(memoryview(x).cast("I")) for x in encoder.encode_all(texts)] == [reference.encode_ordinary(t) for t in texts]
        encoder.forget()
    assert {"kinds", "_ends"} <= set(vars(encoder.transducer))
    every = "".join(map(chr, range(0x110000)))
    assert encoder.white == frozenset(regex.findall(r"\s", every))
    assert encoder.doubtful == frozenset(regex.findall(r"\p{L}", every)) ^ frozenset(c for c in every if c.isalpha())


def test_words_are_told_apart_over_batches_and_tasks(monkeypatch):
    """Each different piece of a part of many batches is encoded once; it was once for each batch of 1000 rows, and again for each task."""
    with open(PATH, "rb") as f:
        ranks = byte_bpe.read_ranks(f.read())
    encoder = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN)
    made = []
    monkeypatch.setattr(byte_bpe.Machine, "encode", lambda self, pieces, f=byte_bpe.Machine.encode: made.extend(pieces) or f(self, pieces))
    reference = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [f"qwxz{i % 40}zq  vbnqk{chr(97 + i % 26)}wq, \n xqvjzk{chr(97 + i % 26)} été{chr(97 + i % 26)}qx.\n" for i in range(400)] + ["", None, " ", "\n a", "a \n"]
    for _ in range(2):
        got = [x for _, ids in encoder.encode_series(iter([pd.Series(texts[a : a + 50], dtype=object) for a in range(0, len(texts), 50)])) for x in ids]
        assert [list(memoryview(x).cast("I")) for x in got] == [reference.encode_ordinary(t or "") for t in texts]
    assert len(made) == len(set(made)) > 50


def test_many_pairs_are_judged_as_one_by_one():
    with open(PATH, "rb") as f:
        transducer = byte_bpe.Transducer(byte_bpe.read_ranks(f.read()))
    rng = np.random.default_rng(3)
    a, b = (np.array(transducer._merged, np.int64)[(len(transducer._merged) * rng.random(5_000) ** 3).astype(int)] for _ in range(2))
    assert transducer._apart_all(a, b).tolist() == [transducer._apart(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_texts_for_the_model_take_one_python_worker_a_task(spark):
    """The filter and the compression were two functions, each with a worker of its own in every task."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3_000)], "id long, text string")
    ids = docs.filter("id % 100 = 7").select("id")
    done = docs.select("id", quality._squeezed_if_in(ids, F.col("id"), F.col("text")).alias("packed")).filter("packed is not null")
    assert done._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = {r["id"]: zstandard.ZstdDecompressor().decompress(bytes(r["packed"])).decode() for r in done.collect()}
    assert {i for i in range(3_000) if i % 100 == 7} <= set(got) and len(got) < 300 and all(got[i] == f"text {i}" for i in got)


def test_texts_are_cut_once_if_a_filter_follows(spark):
    """A filter on the texts that are left was pushed below, and they were cut for it as well, in a second Python worker of each task."""
    line = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"{line} a"), (2, f"b {line} c")], "doc_id long, text string")
    for left in (substring_dedup.dedup_units(docs), passages.drop_passages(docs)):
        kept = left.filter(F.col("text").rlike(r"\S"))
        kept.collect()
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert plan.split("== Initial Plan ==")[0].count("ArrowEvalPython") == 1
