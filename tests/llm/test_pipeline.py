"""The registered queries and the pipeline on the smallest tables."""

import math
import os
import re
from collections import Counter
from hashlib import md5

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm.test_passages import plain_words_left
from tests.llm.test_texts import PATH, plain_components, plain_lines
from tests.test_queries import SF, normal
from weftgraph.llm import byte_bpe, mixing, quality, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert normal(queries.QUERIES[name](spark, SF).toPandas()) == normal(con.execute(queries.ORACLES[name]).df())


@pytest.mark.skipif(not os.path.exists(f"{SF}/labels.parquet"), reason="needs the driver's tables")
def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "jaccard_join", "substring_dedup", "source_mixing", "byte_bpe"]
    docs = corpus_pipeline.load(spark, SF, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0
    done = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert done.count() == counts[4] and done.filter("not round_trip or n_tokens <> size(token_ids)").count() == 0


def rows_of(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


def plain_mix(rows):
    """How often each id is there: the inverse of its source's Poisson distribution at a hash of the id."""
    sizes = Counter(s for *_, s in rows)
    total = sum(n**mixing.TEMPERATURE for n in sizes.values())
    out = Counter()
    for i, _, _, source in rows:
        rate = sizes[source] ** mixing.TEMPERATURE / total * len(rows) / sizes[source]
        u = int(md5(f"{mixing.SEED}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        k, p, upto = 0, math.exp(-rate), math.exp(-rate)
        while upto <= u:
            k += 1
            p *= rate / k
            upto += p
        out[i] += k
    return Counter({i: n for i, n in out.items() if n})


def test_each_stage_against_plain_python(spark):
    """On the smallest tables, with nulls, empty and blank texts and a repeated row besides: which documents and which words each stage keeps."""
    import corpus_pipeline

    kept = corpus_pipeline.COLUMNS
    odd = [(10_001, None, "en", "s", 0), (10_002, "", None, "s", 0), (10_003, "\n\t \n", "en", None, 4), (None, "A text without an id that says a few words of its own.", "en", "s", 54)]
    docs = corpus_pipeline.load(spark, SF, "documents").select(*kept)
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    stages = dict(corpus_pipeline.STAGES)

    # 1: what the classifier (tested against a plain model) accepts, and nothing else; labelled rows go where their labels say
    good = corpus_pipeline.materialize(stages["quality_classifier"](spark, docs, SF), "q")
    judged = quality.classify(docs, corpus_pipeline.load(spark, SF, "labels"))
    assert sorted(map(str, rows_of(good))) == sorted(map(str, rows_of(docs.join(judged.filter("accepted").select(F.col("doc_id").alias("d")).distinct(), F.col("doc_id").eqNullSafe(F.col("d"))).select(*kept))))
    said = {r["doc_id"]: r["quality"] for r in corpus_pipeline.load(spark, SF, "labels").collect()}
    ids = {i for i, *_ in rows_of(good)}
    assert sum(i in ids for i, q in said.items() if q) >= 0.97 * sum(said.values())
    assert sum(i in ids for i, q in said.items() if not q) <= 0.1 * sum(1 - q for q in said.values())
    assert not ids & {10_001, 10_002}

    # 2: of each group linked at 0.8 over five words, the smallest id; from here on all odd rows take part
    dealt = good.unionByName(spark.createDataFrame(odd, docs.schema)).filter("doc_id <> 10003 or doc_id is null").unionByName(spark.createDataFrame(odd[2:3], docs.schema))
    before = rows_of(dealt)
    one = corpus_pipeline.materialize(stages["jaccard_join"](spark, dealt, SF), "j")
    wanted = [i for i, n, least, _ in plain_components(before, 5, 80) if not n or i is None or least == i]
    assert sorted((i for i, *_ in rows_of(one)), key=str) == sorted(wanted, key=str)

    # 3: no repeated lines, sentences or runs of 50 words
    named = one.filter("doc_id is not null")
    before = rows_of(named)
    left = {r["doc_id"]: r["text"] for r in stages["substring_dedup"](spark, named, SF).collect()}
    lines = [(i, t, "", "") for i, t, _ in plain_lines(before)]
    had = {i: bool(t and re.search(r"\S", t)) for i, t, *_ in before}
    lines = [r for r in lines if not had[r[0]] or re.search(r"\S", r[1])]
    words = {i: w for i, w in plain_words_left(lines, 50).items() if w or not had[i]}
    assert {i: (t or "").split() for i, t in left.items()} == words

    # 4: as often as the source's rate and the id say, and only whole rows
    mixed = corpus_pipeline.materialize(stages["source_mixing"](spark, one, SF), "m")
    before = rows_of(one)
    assert Counter(i for i, *_ in rows_of(mixed)) == plain_mix(before) and set(rows_of(mixed)) <= set(before)

    # 5: the tokenizer's ids
    reference = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(open(PATH, "rb").read()), special_tokens={})
    tokens = stages["byte_bpe"](spark, one, SF).collect()
    assert len(tokens) == len(before) and all(list(r["token_ids"]) == reference.encode_ordinary(r["text"] or "") and r["round_trip"] for r in tokens)

    # an empty table, and columns named like those the stages make
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name
    clash = docs.limit(60).selectExpr(*kept, "1 AS print", "2 AS score", "3 AS copy", "4 AS n_units", "5 AS lines", "6 AS rate", "7 AS token_ids")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, clash, SF).columns[:5] == kept, name
