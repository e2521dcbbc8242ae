"""Toxicity: nearest labelled examples by exact TF-IDF cosine, found in a block-max inverted index; distance-weighted votes give calibrated scores and evidence."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import bound_batches, materialize, scratch
from weftgraph.llm.shingles import chunks, term_hashes

#: Labelled examples of either class that the index holds unless told otherwise, those of smallest id hash: the only bounded part, as a fit on labels may be.
TOXIC_EXAMPLES, CLEAN_EXAMPLES = 2_048, 4_096
#: Terms are words and their first bytes. The space of the cosine is made of those that go with toxic examples, by a chi-square that among all terms tested even one would reach by chance with this
#: probability at most. So few examples don't make a space of chance words, and there is no limit to the number of terms.
STEMS = (4, 5, 6)
CHANCE = 0.05
NEIGHBOURS = 16
BLOCK = 64
THRESHOLD = 0.3


class BlockMaxIndex:
    """Postings of unit TF-IDF vectors in the order of (term, block), with the largest weight of each term in each block of BLOCK examples. Examples are placed by their heaviest term, so that few blocks have large bounds."""

    def __init__(self, rows: list[np.ndarray], weights: list[np.ndarray], n_terms: int) -> None:
        self.n = len(rows)
        self.blocks = max(1, -(-self.n // BLOCK))
        heaviest = np.array([r[np.argmax(w)] if len(r) else n_terms for r, w in zip(rows, weights, strict=True)], np.int64)
        self.example = np.argsort(heaviest, kind="stable")  # place -> example
        place = np.empty(self.n, np.int64)
        place[self.example] = np.arange(self.n)
        of = np.repeat(place, [len(r) for r in rows])
        term = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        weight = np.concatenate(weights) if rows else np.zeros(0)
        self.most = np.zeros((n_terms, self.blocks))
        np.maximum.at(self.most, (term, of // BLOCK), weight)
        order = np.lexsort((of, term))
        self.of, self.weight = of[order], weight[order]
        #: Where the postings of a term in a block begin, at term * blocks + block.
        self.starts = np.searchsorted(term[order] * self.blocks + self.of // BLOCK, np.arange(n_terms * self.blocks + 1))
        self.read = 0  # postings so far

    def _postings(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and shares of the cosine of the postings of terms in blocks; no other posting is touched."""
        lists = (terms[:, None] * self.blocks + blocks).ravel()
        begin, size = self.starts[lists], self.starts[lists + 1] - self.starts[lists]
        at = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
        self.read += len(at)
        return self.of[at], self.weight[at] * np.repeat(np.repeat(weights, len(blocks)), size)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine above 0 and these cosines. Blocks are opened by falling bound, twice as many each time, until no bound could change the result."""
        bounds = weights @ self.most[terms]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        ids, sims = np.zeros(0, np.int64), np.zeros(0)
        done, step = 0, 2
        while done < len(order) and not (len(ids) == k and bounds[order[done]] < sims[-1] - 1e-9):
            opened = order[done : done + step]
            if len(ids) == k:
                opened = opened[bounds[opened] >= sims[-1] - 1e-9]
            of, share = self._postings(terms, weights, opened)
            done, step = done + step, 2 * step
            found = np.bincount(of, share, self.n)
            new = np.flatnonzero(found)
            ids, sims = np.r_[ids, self.example[new]], np.r_[sims, np.round(np.minimum(found[new], 1.0), 12)]
            if without >= 0:
                ids, sims = ids[ids != without], sims[ids != without]
            if len(ids) > 4 * k:
                some = sims >= -np.partition(-sims, k)[k]
                ids, sims = ids[some], sims[some]
            keep = np.lexsort((ids, -sims))[:k]
            ids, sims = ids[keep], sims[keep]
        return ids, sims


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest to y at x (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


class Model:
    """Vocabulary, index, votes and calibration; of bounded size."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, examples: pd.DataFrame, class_weight: tuple[float, float]) -> None:
        self.terms, self.idf = terms, idf
        self.ids, self.toxic = examples["doc_id"].to_numpy(), examples["toxic"].to_numpy(np.int64)
        self.weight = np.array(class_weight)[self.toxic] if len(examples) else np.zeros(0)
        rows, weights = zip(*(self.vector(np.asarray(t, np.int64), np.asarray(c, np.float64)) for t, c in zip(examples["terms"], examples["counts"], strict=True)), strict=True) if len(examples) else ((), ())
        self.index = BlockMaxIndex(list(rows), list(weights), len(terms))
        total = self.weight.sum()
        self.base = float((self.weight * self.toxic).sum() / total) if total else 0.0
        empty = np.array([len(r) == 0 for r in rows], bool)
        plain = self.weight[empty].sum()
        self.none = float(((self.weight * self.toxic)[empty].sum() + self.base) / (plain + 1)) if total else 0.0
        told = np.flatnonzero(~empty)
        # each example is judged by the others
        raw = np.array([self.vote(*self.index.nearest(rows[i], weights[i], NEIGHBOURS, i)) for i in told.tolist()])
        self.knots = isotonic(raw, self.toxic[told].astype(float), self.weight[told]) if len(told) else (np.zeros(1), np.full(1, self.base))

    def vector(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.idf[at] if len(at) else np.zeros(0)
        size = np.sqrt((w * w).sum())
        return at, w / size if size else w

    def count(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Known terms among hashes, and how often they are there."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.unique(at[self.terms[at] == hashes], return_counts=True)

    def vote(self, ids: np.ndarray, sims: np.ndarray) -> float:
        w = self.weight[ids] / (1.05 - sims)
        return float(((w * self.toxic[ids]).sum() + self.base) / (w.sum() + 1))

    def judge(self, at: np.ndarray, counts: np.ndarray) -> tuple[float, list[tuple[int, float, int]]]:
        """The score, and the nearest examples with their cosines and labels."""
        if not len(at):
            return self.none, []
        ids, sims = self.index.nearest(*self.vector(at, counts), NEIGHBOURS)
        score = float(np.interp(self.vote(ids, sims), *self.knots)) if len(ids) else self.none
        return score, [(self.ids[i], float(s), int(self.toxic[i])) for i, s in zip(ids[:3], sims[:3], strict=True)]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 4, is 2. A null id is held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(True))


def _terms_of(texts: list[str]) -> Iterator[np.ndarray]:
    for part in chunks([t.encode() for t in texts]):
        hashes, of = term_hashes(part, STEMS)
        order = np.argsort(of, kind="stable")
        hashes, of = hashes[order], of[order]
        bounds = np.searchsorted(of, np.arange(len(part) + 1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield hashes[a:b]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_examples: int = TOXIC_EXAMPLES, clean_examples: int = CLEAN_EXAMPLES) -> Model:
    """A model of the examples; the driver gets their terms that go with toxic ones, and their vectors over these. How many documents hold a term is counted over all documents."""
    spark = docs.sparkSession
    bound_batches(spark)
    usable = labels.filter(F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).filter(~held_out(F.col("doc_id")))
    totals = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    pick = lambda t, n: usable.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select(F.col("doc_id").cast("string").alias("doc_id"), "toxic")
    chosen = pick(1, toxic_examples).unionByName(pick(0, clean_examples)).toPandas()
    kind = docs.schema[id_col].dataType.simpleString()
    picked = spark.createDataFrame([(str(i), int(t)) for i, t in zip(chosen["doc_id"], chosen["toxic"], strict=True)], "doc_id string, toxic int").withColumn("doc_id", F.col("doc_id").cast(kind))
    every = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # equal texts are one example, of the least id, toxic if any of them is: one that is its own neighbour would vouch for itself
    rows = every.join(F.broadcast(picked), "doc_id").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    rows = materialize(rows, "examples")

    def statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for label, of in df.groupby("toxic"):
                seen = [np.unique(h) for h in _terms_of(of["text"].tolist())]
                term, count = np.unique(np.concatenate(seen), return_counts=True)
                yield pd.DataFrame({"term": term.view(np.int64), "toxic": label, "c": count})

    counts = rows.mapInPandas(statistics, "term long, toxic int, c long").groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("c")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("c")).otherwise(0)).alias("b"))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    t, c = sizes.get(1, 0), sizes.get(0, 0)
    counts = materialize(counts, "term-counts")
    least = NormalDist().inv_cdf(1 - CHANCE / max(counts.count(), 1) / 2) ** 2
    n, a, b = float(t + c), F.col("a").cast("double"), F.col("b").cast("double")
    chi2 = n * F.pow(a * (c - b) - b * (t - a), 2) / F.greatest((a + b) * (n - a - b) * float(max(t * c, 1)), F.lit(1.0))
    terms = counts.filter(a * c > b * t).withColumn("chi2", chi2).filter(F.col("chi2") >= least).select("term").toPandas()
    hashes = np.sort(terms["term"].to_numpy(np.int64).view(np.uint64))
    none = pd.DataFrame({"doc_id": [], "toxic": [], "terms": [], "counts": []})
    shell = spark.sparkContext.broadcast(Model(hashes, np.ones(len(hashes)), none, (1.0, 1.0)))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, total, seen = shell.value, 0, np.zeros(len(hashes) + 1, np.int64)
        for df in batches:
            for h in _terms_of(df["text"].tolist()):
                seen[known.count(h)[0]] += 1
                total += 1
        seen[-1] = total
        there = np.flatnonzero(seen)
        yield pd.DataFrame({"at": there, "c": seen[there]})

    found = every.select("text").mapInPandas(frequencies, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).toPandas()
    held = np.zeros(len(hashes) + 1)
    held[found["at"].to_numpy(np.int64)] = found["c"]
    idf = np.log((1 + held[-1]) / (1 + held[:-1])) + 1

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shell.value
        for df in batches:
            got = [known.count(h) for h in _terms_of(df["text"].tolist())]
            yield pd.DataFrame({"doc_id": df["doc_id"], "toxic": df["toxic"], "terms": [x for x, _ in got], "counts": [y for _, y in got]})

    once = rows.mapInPandas(vectors, f"doc_id {kind}, toxic int, terms array<long>, counts array<long>").toPandas().sort_values("doc_id", ignore_index=True)
    weight = totals.get(0, 0) / max(c, 1), totals.get(1, 0) / max(t, 1)
    return Model(hashes, idf, once, tuple(w / max(min(weight), 1e-9) for w in weight))


def _fitted(docs: DataFrame, *args) -> Model:
    with scratch(docs.sparkSession):
        return train(docs, *args)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_examples: int = TOXIC_EXAMPLES, clean_examples: int = CLEAN_EXAMPLES) -> DataFrame:
    """doc_id, held_out, score (probability that the label is 1), predicted (score >= THRESHOLD) and evidence (nearest examples, with cosine and label) for each row of docs.

    Learnt from are at most toxic_examples and clean_examples labelled rows; a text that several of them have is one example, toxic if one of them is. A score depends on the text alone. Texts without a term of the vocabulary, null and empty ones included, have the share of toxic examples among such. Without usable labels every score is 0. Rows that
    repeat an id are scored each; a null id is held out. Ids are whole numbers or strings. The index is a broadcast of bounded size; documents are not moved.
    """
    model = docs.sparkSession.sparkContext.broadcast(_fitted(docs, labels, id_col, text_col, toxic_examples, clean_examples))

    @F.pandas_udf(f"score double, evidence array<struct<doc_id:{docs.schema[id_col].dataType.simpleString()},cosine:double,toxic:int>>")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = model.value
        for texts in batches:
            out = [own.judge(*own.count(h)) for h in _terms_of(texts.tolist())]
            yield pd.DataFrame({"score": [x for x, _ in out], "evidence": [[{"doc_id": i, "cosine": s, "toxic": t} for i, s, t in y] for _, y in out]})

    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), judged(F.coalesce(F.col(text_col), F.lit(""))).alias("j"))
    return scored.select("doc_id", "held_out", "j.score", (F.col("j.score") >= THRESHOLD).cast("int").alias("predicted"), "j.evidence")
