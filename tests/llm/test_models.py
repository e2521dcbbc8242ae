"""Operators that learn, and the search of vectors."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import neighbours, quality, toxicity

DOCS = "doc_id long, text string, lang string, print string, score double, nll double"
LABELS = "doc_id long, quality int, toxic int"


def sentence(rng, n=60):
    return " ".join("".join(rng.choice(["la", "ro", "mi", "ten", "su"]) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        text, toxic, good = sentence(rng), int(i % 5 == 0), int(i % 4 != 1)
        if toxic:
            words = text.split()
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["grunk", "bloof", "snarg"]))
            text = " ".join(words)
        if not good:
            text = text.upper().replace(" ", "!! ")
        rows.append((i, text, "xx" if i % 7 else None))
        labels.append((i, good, toxic))
    rows += [(1000, None, "xx"), (1001, "", None), (1002, "la", "zz"), (None, rows[2][1], "xx"), (1003, rows[2][1] * 400, "xx"), (3, rows[3][1], "xx")]
    docs = spark.createDataFrame([(*r, "p", 0.0, 0.0) for r in rows], DOCS)
    return rows, docs, spark.createDataFrame(labels, LABELS), {i: (g, t) for i, g, t in labels}


def test_toxic_documents_are_told(corpus):
    rows, docs, labels, known = corpus
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"] and r["doc_id"] in known]
    assert len(held) > 60 and sum(r["predicted"] == known[r["doc_id"]][1] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    by_text = {}
    texts = [t for _, t, _ in rows]
    for r in got:
        text = next((t for i, t, _ in rows if i == r["doc_id"]), None)
        assert by_text.setdefault(text, r["score"]) == r["score"]
    assert None in texts


def test_toxicity_without_labels_or_documents(corpus):
    _, docs, labels, _ = corpus
    assert {r["score"] for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_with_string_ids(corpus):
    """The same scores as with the numbers that the strings are of, as far as the order of ids picks the same examples; evidence names rows by their ids."""
    _, docs, labels, _ = corpus
    named = [d.withColumn("doc_id", F.col("doc_id").cast("string")) for d in (docs, labels)]
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(*named).collect()}
    for r in toxicity.score_toxicity(docs, labels).collect():
        if r["doc_id"] is not None:
            assert got[str(r["doc_id"])]["held_out"] == r["held_out"] and abs(got[str(r["doc_id"])]["score"] - r["score"]) < 0.2
    assert all(isinstance(e["doc_id"], str) for r in got.values() for e in r["evidence"])


def test_neighbours_need_whole_numbers(spark):
    rows = spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>")
    with pytest.raises(ValueError, match="whole numbers"):
        neighbours.nearest_neighbours(rows, F.lit(True))


def test_the_index_gives_the_nearest():
    rng = np.random.default_rng(1)
    rows, weights = [], []
    for _ in range(700):
        at = np.sort(rng.choice(50, rng.integers(0, 6), replace=False))
        w = rng.random(len(at))
        rows.append(at)
        weights.append(w / np.sqrt((w * w).sum()) if len(at) else w)
    index = toxicity.BlockMaxIndex(rows, weights, 50)
    dense = np.zeros((700, 50))
    for i, (r, w) in enumerate(zip(rows, weights, strict=True)):
        dense[i, r] = w
    for i in range(0, 700, 9):
        if not len(rows[i]):
            continue
        sims = np.round(np.minimum(dense @ dense[i], 1), 12)
        sims[i] = 0
        wanted = [j for j in np.lexsort((np.arange(700), -sims))[:16].tolist() if sims[j] > 0]
        assert index.nearest(rows[i], weights[i], 16, i)[0].tolist() == wanted


def test_blocks_that_cannot_matter_are_not_read():
    rng = np.random.default_rng(4)
    rows, weights = [], []
    for i in range(3_000):
        # topics of their own, and terms that all may have
        at = np.unique(np.r_[rng.choice(np.arange(20) + 20 * (i % 60), 6), rng.choice(np.arange(1200, 1240), 2)])
        w = np.where(at < 1200, 3.0, 0.3) * (0.5 + rng.random(len(at)))
        rows.append(at)
        weights.append(w / np.sqrt((w * w).sum()))
    index = toxicity.BlockMaxIndex(rows, weights, 1240)
    dense = np.zeros((3_000, 1240))
    for i, (r, w) in enumerate(zip(rows, weights, strict=True)):
        dense[i, r] = w
    every = 0
    for i in range(0, 3_000, 50):
        every += sum(int((dense[:, t] > 0).sum()) for t in rows[i])
        sims = np.round(np.minimum(dense @ dense[i], 1), 12)
        sims[i] = 0
        assert index.nearest(rows[i], weights[i], 16, i)[0].tolist() == np.lexsort((np.arange(3_000), -sims))[:16].tolist()
    assert index.read < 0.8 * every


def test_scores_are_those_of_a_dense_model(corpus):
    """TF-IDF, cosines with all examples, votes, calibration and scores without an index; and two runs say the same."""
    rows, docs, labels, _ = corpus
    model = toxicity.train(docs, labels)
    texts = [t or "" for _, t, _ in rows]
    hashes = [np.array(h) for h in toxicity._terms_of(texts)]
    place = {h: k for k, h in enumerate(model.terms.tolist())}
    count = np.zeros((len(texts), len(place)))
    for i, found in enumerate(hashes):
        for h in found.tolist():
            if h in place:
                count[i, place[h]] += 1
    idf = np.log((1 + len(texts)) / (1 + (count > 0).sum(axis=0))) + 1
    assert np.allclose(idf, model.idf)
    dense = np.where(count > 0, 1 + np.log(np.maximum(count, 1)), 0) * idf
    size = np.sqrt((dense * dense).sum(axis=1, keepdims=True))
    dense = np.divide(dense, size, out=np.zeros_like(dense), where=size > 0)
    first = {i: k for k, (i, _, _) in reversed(list(enumerate(rows))) if i is not None}
    examples = np.array([dense[first[i]] for i in model.ids.tolist()])

    def vote(v, without=None):
        sims = np.round(np.minimum(examples @ v, 1), 12)
        near = [j for j in np.lexsort((np.arange(len(sims)), -sims)).tolist() if sims[j] > 0 and j != without][: toxicity.NEIGHBOURS]
        w = model.weight[near] / (1.05 - sims[near])
        return ((w * model.toxic[near]).sum() + model.base) / (w.sum() + 1), len(near)

    told = [j for j in range(len(examples)) if examples[j].any()]
    knots = toxicity.isotonic(np.array([vote(examples[j], j)[0] for j in told]), model.toxic[told].astype(float), model.weight[told])
    got = toxicity.score_toxicity(docs, labels).collect()
    by_text = {}
    for (i, _, _), v in zip(rows, dense, strict=True):
        raw, n = vote(v)
        by_text.setdefault(i, set()).add(round(float(np.interp(raw, *knots)) if n else model.none, 9))
    assert all(round(r["score"], 9) in by_text[r["doc_id"]] for r in got)
    again = toxicity.score_toxicity(docs.repartition(7), labels.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_equal_texts_with_different_labels_are_one_toxic_example(spark, corpus):
    rows, docs, labels, known = corpus
    free = [r["doc_id"] for r in labels.filter(~toxicity.held_out(F.col("doc_id"))).collect() if known[r["doc_id"]][1] == 0][:2]
    twins = docs.withColumn("text", F.when(F.col("doc_id").isin(free), F.lit("two of a kind")).otherwise(F.col("text")))
    mixed = labels.withColumn("toxic", F.when(F.col("doc_id") == free[1], 1).otherwise(F.col("toxic")))
    model = toxicity.train(twins, mixed)
    assert model.ids.tolist().count(min(free)) == 1 and max(free) not in model.ids.tolist()
    assert model.toxic[model.ids.tolist().index(min(free))] == 1


def test_isotonic_is_rising_and_keeps_the_mean():
    rng = np.random.default_rng(2)
    x, y, w = rng.random(200), (rng.random(200) < 0.4).astype(float), rng.random(200) + 0.1
    at, level = toxicity.isotonic(x, y, w)
    assert (np.diff(level) > 0).all() and (np.diff(at) > 0).all()


def test_bad_documents_are_rejected(corpus):
    rows, docs, labels, known = corpus
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows)
    judged = [(r["accepted"], known[r["doc_id"]][0]) for r in got if r["doc_id"] in known]
    assert all(not a for a, g in judged if not g) and sum(a for a, g in judged if g) >= 0.97 * sum(g for _, g in judged)
    empty = {r["doc_id"]: r for r in got if r["doc_id"] in (1000, 1001)}
    assert all(not r["accepted"] and r["perplexity"] is None for r in empty.values())
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["accepted"] for r in got)


def test_quality_without_labels_or_documents(corpus):
    _, docs, labels, _ = corpus
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.filter(F.length("text") > 0).count()
    assert quality.classify(docs.limit(0), labels).count() == 0


class PlainModel:
    """Interpolated modified Kneser-Ney over tuples of symbols, in loops."""

    def __init__(self, texts):
        order = quality.ORDER
        self.grams = [collections.Counter() for _ in range(order + 1)]
        for t in texts:
            self.grams[order].update(self.of(t))
        for n in range(order - 1, 0, -1):
            self.grams[n].update(g[1:] for g in self.grams[n + 1])
        self.cuts, self.contexts = {}, {}
        for n in range(1, order + 1):
            t = collections.Counter(self.grams[n].values())
            y = t[1] / (t[1] + 2 * t[2]) if t[1] + 2 * t[2] else None
            self.cuts[n] = [0.0]
            for k in (1, 2, 3):
                d = k - (k + 1) * y * t[k + 1] / t[k] if y is not None and t[k] else None
                self.cuts[n].append(d if d is not None and 0 < d < k else (k * 0.5 if k < 3 else 1.4))
            self.contexts[n] = collections.defaultdict(list)
            for g, c in self.grams[n].items():
                self.contexts[n][g[:-1]].append(c)

    @staticmethod
    def of(text):
        symbols = [0] * (quality.ORDER - 1) + quality._symbols(np.array([ord(c) for c in text])).tolist()
        return [tuple(symbols[i : i + quality.ORDER]) for i in range(len(text))]

    def p(self, gram):
        if not gram:
            return 1 / quality.SYMBOLS
        n, below = len(gram), self.p(gram[1:])
        after = self.contexts[n].get(gram[:-1])
        if not after:
            return below
        c, cuts = self.grams[n].get(gram, 0), self.cuts[n]
        return (c - cuts[min(c, 3)]) / sum(after) + sum(cuts[min(x, 3)] for x in after) / sum(after) * below


def test_counts_shares_and_scores_are_those_of_a_plain_model(spark, monkeypatch):
    """Perplexities through sharded joins, in slices, against loops; among the texts are CJK, astral, long and empty ones."""
    monkeypatch.setattr(quality, "SLICE_CHARS", 50)
    rng = random.Random(5)
    texts = [sentence(rng, 8) for _ in range(30)] + ["abab abab", "abba", "b", "日本語の文章です。" * 3, "ж𝒳😀é", sentence(rng, 90)]
    rows = [(i, t, "x" if i % 2 else "rare") for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, len(texts), 2)], LABELS)
    docs = spark.createDataFrame([*rows, (900, None, "x"), (901, "", None)], "doc_id long, text string, lang string")
    langs, model = quality.train(docs, labels)
    assert langs.count() == 0
    back = {r["doc_id"] for r in docs.filter(quality._kept_back(F.col("doc_id"))).collect()}
    trained = [t for i, t, _ in rows if i % 2 == 0 and i not in back]
    assert 0 < len(trained) < 18
    plain = PlainModel(trained)
    stored = {(r["n"], r["code"]): r["value"] for r in model.filter("lang = '*'").collect()}
    assert sum(code >= 0 for _, code in stored) == sum(map(len, plain.grams))
    for n, grams in enumerate(plain.grams[1:], 1):
        for g, c in grams.items():
            code = sum(x << quality.BITS * (n - 1 - k) for k, x in enumerate(g))
            assert stored[n, code] == pytest.approx((c - plain.cuts[n][min(c, 3)]) / sum(plain.contexts[n][g[:-1]]))
    got = {r["id"]: r for r in quality.score(docs, langs, model).collect()}
    assert len(got) == len(texts) + 2 and got[900]["n_scored"] == got[901]["n_scored"] == 0
    for i, t, _ in rows:
        assert got[i]["n_scored"] == len(t) and got[i]["nll"] == pytest.approx(-sum(np.log(plain.p(g)) for g in PlainModel.of(t)), rel=1e-3, abs=1e-3 * len(t))


def test_probabilities_after_a_context_sum_to_one(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, sentence(rng), "xx") for i in range(60)], "doc_id long, text string, lang string")
    _, model = quality.train(docs, spark.createDataFrame([(i, 1, 0) for i in range(60)], LABELS))
    rows = model.filter("lang = 'xx'").toPandas()
    code, n = rows["code"].to_numpy(), rows["n"].to_numpy()
    keys = np.where(code >= 0, n << 60 | code, -1 - (n << 60 | (-1 - code)))
    order = np.argsort(keys)
    for context in (0, *quality.gram_codes(["la roten"])[0][4:7].tolist()):
        grams = (context << quality.BITS & ((1 << quality.BITS * quality.ORDER) - 1)) | np.arange(quality.SYMBOLS)
        assert quality.probabilities(grams, keys[order], rows["value"].to_numpy()[order]).sum() == pytest.approx(1, abs=1e-6)


@pytest.mark.parametrize("lang, letters", [("zh", [chr(0x4E00 + 37 * k % 3000) for k in range(400)]), ("ru", [chr(c) for c in range(0x430, 0x450)])])
def test_clean_text_of_other_scripts_is_told_from_shuffled(spark, lang, letters):
    rng = random.Random(7)
    words = ["".join(rng.choices(letters, k=rng.randrange(2, 5))) for _ in range(60)]
    clean = [" ".join(rng.choices(words, k=60)) for _ in range(150)]
    shuffled = ["".join(rng.sample(t, len(t))) for t in clean[:50]]
    docs = spark.createDataFrame([(i, t, lang) for i, t in enumerate(clean + shuffled)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)], LABELS)
    got = {r["doc_id"]: r["accepted"] for r in quality.classify(docs, labels).collect()}
    assert sum(got[i] for i in range(100, 150)) >= 48 and not any(got[i] for i in range(150, 200))


def test_repeated_words_are_rejected_and_copies_and_ties_get_one_score(spark):
    rng = random.Random(9)
    rows = [(i, sentence(rng), "xx") for i in range(80)] + [(500 + i, rows_word * 80, "xx") for i, rows_word in enumerate(("la ", "roten ", "misu "))]
    rows += [(600, rows[3][1], "xx"), (3, rows[3][1], "xx"), (601, rows[3][1], "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality.classify(docs, spark.createDataFrame([(i, 1, 0) for i in range(80)], LABELS)).collect()
    assert len(got) == len(rows)
    assert not any(r["accepted"] for r in got if 500 <= r["doc_id"] < 600)
    assert len({(r["score"], r["variety"]) for r in got if r["doc_id"] in (3, 600, 601)}) == 1


def test_the_filter_of_bounded_size_misses_no_id(spark, monkeypatch):
    monkeypatch.setattr(quality, "FILTER_BITS", 1 << 15)
    ids = spark.range(0, 100_000, 7).toDF("id")
    kept = spark.range(100_000).toDF("x").filter(quality._maybe_in(ids, F.col("x")))
    assert kept.filter("x % 7 = 0").count() == ids.count()
    few = spark.range(0, 100_000, 1000).toDF("id")
    assert 100 <= spark.range(100_000).toDF("x").filter(quality._maybe_in(few, F.col("x"))).count() < 3_000


def vectors(spark, n=600, dims=16):
    rng = np.random.default_rng(7)
    m = rng.standard_normal((n, dims)).astype(np.float32)
    m[5], m[50:60] = m[4], m[4]
    rows = [(i, m[i].tolist()) for i in range(n)]
    rows += [(9000, None), (9001, []), (9002, [0.0] * dims), (9003, [float("nan")] * dims), (9004, [1.0] * (dims - 1)), (9020, [float("inf")] + [1.0] * (dims - 1)), (9040, [None] + [1.0] * (dims - 1)), (None, m[1].tolist())]
    return m, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_neighbours_against_all(spark):
    m, df = vectors(spark)
    ask = F.col("vec_id") % 20 == 0
    for leaf_rows, least in ((1000, 1.0), (64, 0.9)):
        got = {}
        for r in neighbours.nearest_neighbours(df, ask, 20, leaf_rows=leaf_rows).collect():
            got.setdefault(r["query_id"], []).append(r)
        assert set(got) == set(range(0, 600, 20))
        hits = 0
        for q, found in got.items():
            scores = m.astype(np.float64) @ m[q].astype(np.float64)
            order = [int(i) for i in np.lexsort((np.arange(600), -np.round(scores, 12))) if i != q][:20]
            found.sort(key=lambda r: r["rank"])
            assert [r["rank"] for r in found] == list(range(1, 21))
            assert all(abs(r["score"] - scores[r["vec_id"]]) < 1e-12 for r in found)
            hits += len({r["vec_id"] for r in found} & set(order))
            if leaf_rows == 1000:
                assert [r["vec_id"] for r in found] == order
        assert hits >= least * 20 * len(got)


def test_few_or_no_vectors(spark):
    _, df = vectors(spark)
    few = df.filter("vec_id < 4")
    assert neighbours.nearest_neighbours(few, F.col("vec_id") == 0).count() == 3
    assert neighbours.nearest_neighbours(few.unionByName(few), F.col("vec_id") == 0).count() == 3
    assert neighbours.nearest_neighbours(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert neighbours.nearest_neighbours(df.filter("vec_id >= 9000"), F.col("vec_id") == 9000).count() == 0
