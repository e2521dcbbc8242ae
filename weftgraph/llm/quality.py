"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, perplexity for each document, and a threshold for each language.

N-grams are of ORDER characters. Counts are made by all tasks over all trusted text (but for a share that is kept for the thresholds) and summed by shards; probabilities come from joins of these counts with
those of their contexts. No model is gathered anywhere: documents are dealt into parts, each part asks for the n-grams it holds, once each, the shards of the model answer, and the answers meet the part
again. What is asked for grows with the corpus and its vocabulary, and nothing of it depends on how many languages there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import bound_batches, give_back, materialize, partitions, scratch

ORDER = 5
#: Bits of a symbol. Code points below EXACT stand for themselves (Latin, Greek, Cyrillic, Hebrew, Arabic), others for one of as many classes by a hash; 0 is what is before a text.
BITS = 12
SYMBOLS, EXACT = 1 << BITS, 1 << (BITS - 1)
#: Languages with fewer trusted documents than this share one model and one threshold, as do those after the first MOST_LANGS by trusted documents: their list is broadcast.
LEAST_TRUSTED, MOST_LANGS = 20, 100_000
#: One in so many trusted documents isn't counted: their scores, of text that the model hasn't seen, make the thresholds.
KEPT_BACK = 4
#: The quantile of these scores, and how far (in log-perplexity) above it a document is rejected.
QUANTILE, MARGIN = 0.99, 0.05
#: Text that repeats itself is foreseen well. So a document is also rejected whose share of different n-grams in windows of so many characters is below a low quantile by more than a margin.
WINDOW, LOW_QUANTILE, LOW_MARGIN = 200, 0.005, 0.05
#: Characters at the language's mean by which a score is smoothed: a few words say little.
PRIOR_CHARS = 60
POOLED = "*"
#: Characters that a worker handles at a time, n-grams that it holds while counting, and characters of a part.
SLICE_CHARS, HELD_GRAMS, PART_CHARS = 400_000, 3_000_000, 24_000_000
#: Bits of the filter by which most documents without a trusted label stay where they are: 16 for each label, and no more than this (16 MB).
FILTER_BITS = 1 << 27


def _symbols(codes: np.ndarray) -> np.ndarray:
    codes = codes.astype(np.int64)
    if not len(codes) or codes.max() < EXACT:
        return codes
    return np.where(codes < EXACT, codes, EXACT + ((codes * 0x9E3779B1 >> 13) & (EXACT - 1)))


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-gram that ends at each character, BITS bits a symbol, over all texts; and where each text begins in it, with the end of the last."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    padded = np.zeros(len(flat) + (ORDER - 1) * len(texts), np.int64)
    at = np.arange(len(flat)) + (ORDER - 1) * np.repeat(np.arange(1, len(texts) + 1), sizes)
    padded[at] = _symbols(flat)
    codes = np.zeros(len(flat), np.int64)
    for k in range(ORDER - 1, -1, -1):
        codes = codes << BITS | padded[at - k]
    return codes, np.r_[ends - sizes, ends[-1:]]


def _slices(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The codes of neighbouring texts of about SLICE_CHARS characters together, and the number of the text of each. Of a longer text a slice begins with the characters before it."""
    part: list[tuple[int, str, int]] = []
    size = 0

    def made() -> tuple[np.ndarray, np.ndarray]:
        codes, at = gram_codes([t for _, t, _ in part])
        keep = np.concatenate([np.arange(a + skip, b) for (_, _, skip), a, b in zip(part, at[:-1].tolist(), at[1:].tolist(), strict=True)])
        return codes[keep], np.repeat([i for i, _, _ in part], [len(t) - skip for _, t, skip in part])

    for i, text in enumerate(texts):
        for begin in range(0, len(text), SLICE_CHARS):
            before = min(begin, ORDER - 1)
            part.append((i, text[begin - before : begin + SLICE_CHARS], before))
            size += len(part[-1][1])
            if size >= SLICE_CHARS:
                yield made()
                part, size = [], 0
    if part:
        yield made()


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([a[1], b[1]]), len(codes)).astype(np.int64)


class _Counts:
    """Counts of n-grams; slices are merged when they are as many as what is merged already."""

    def __init__(self) -> None:
        self.done = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.open: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, codes: np.ndarray) -> None:
        self.open.append(np.unique(codes, return_counts=True))
        self.held += len(self.open[-1][0])
        if self.held > max(len(self.done[0]), 500_000):
            self.close()

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        if self.open:
            self.done = _merged(self.done, tuple(np.concatenate(x) for x in zip(*self.open, strict=True)))
            self.open, self.held = [], 0
        return self.done


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, packed text) to (lang, gram, c), one row for each n-gram of a task, or of more where it holds over HELD_GRAMS."""
    swell = zstandard.ZstdDecompressor()
    counts: dict[str, _Counts] = {}

    def flush() -> Iterator[pd.DataFrame]:
        for lang, found in counts.items():
            grams, c = found.close()
            yield pd.DataFrame({"lang": lang, "gram": grams, "c": c})
        counts.clear()

    for df in batches:
        for lang, packed in df.groupby("lang")["packed"]:
            for codes, _ in _slices([swell.decompress(x).decode() for x in packed]):
                counts.setdefault(lang, _Counts()).add(codes)
        if sum(len(c.done[0]) + c.held for c in counts.values()) > HELD_GRAMS:
            yield from flush()
    yield from flush()
    give_back()


def _tail(code: Column, n: int) -> Column:
    """The last n symbols."""
    return code.bitwiseAND(F.lit((1 << BITS * n) - 1))


def kneser_ney(grams: DataFrame) -> DataFrame:
    """From counts (lang, gram, c) of the highest order: lang, n, code, value for every order n. value is the discounted share (code >= 0) of an n-gram after its context, or the weight of the lower order after a context (code = -1 - context)."""
    top = grams.select("lang", F.lit(ORDER).alias("n"), F.col("gram").alias("code"), "c")
    orders = [top]
    for n in range(ORDER - 1, 0, -1):
        # continuation counts: how many different symbols come before
        above = orders[-1]
        orders.append(above.groupBy("lang", _tail(F.col("code"), n).alias("code")).agg(F.count(F.lit(1)).alias("c")).select("lang", F.lit(n).alias("n"), "code", "c"))
    counts = orders[0]
    for x in orders[1:]:
        counts = counts.unionByName(x)
    counts = materialize(counts.withColumn("context", F.shiftright("code", BITS)), "ngram-counts")
    kinds = [F.count_if(F.col("c") == k).cast("double").alias(f"t{k}") for k in (1, 2, 3, 4)]
    found = counts.groupBy("lang", "n").agg(*kinds)  # a row for each language and order
    y = F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2"))

    def discount(k: int):
        d = k - (k + 1) * y * F.try_divide(F.col(f"t{k + 1}"), F.col(f"t{k}"))
        plain = F.lit(k * 0.5 if k < 3 else 1.4)  # where counts of counts say nothing
        return F.when((d > 0.0) & (d < k), d).otherwise(plain).alias(f"d{k}")

    discounts = F.broadcast(found.select("lang", "n", discount(1), discount(2), discount(3)))
    c = F.col("c")
    contexts = counts.groupBy("lang", "n", "context").agg(F.sum("c").alias("total"), F.count_if(c == 1).alias("n1"), F.count_if(c == 2).alias("n2"), F.count_if(c > 2).alias("n3"))
    after = contexts.join(discounts, ["lang", "n"]).withColumn("left", (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total"))
    after = materialize(after.select("lang", "n", "context", "total", "left", "d1", "d2", "d3"), "ngram-contexts")
    cut = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
    shares = counts.join(after, ["lang", "n", "context"]).select("lang", "n", "code", ((c - cut) / F.col("total")).alias("value"))
    return materialize(shares.unionByName(after.select("lang", "n", (-1 - F.col("context")).alias("code"), F.col("left").alias("value"))), "ngram-model", keep=True)


def _keys(grams: np.ndarray) -> np.ndarray:
    """What the model has to be asked about ORDER-grams: the shares of their ends of every order, and the weights of the contexts of these; as the order (from bit 60 on) and the code, contexts as -1 minus that."""
    out = []
    for n in range(ORDER, 0, -1):
        grams = np.unique(grams & ((1 << BITS * n) - 1)) if n < ORDER else grams
        out += [n << 60 | grams, -1 - (n << 60 | np.unique(grams >> BITS))]
    return np.sort(np.concatenate(out))


def probabilities(grams: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The probability of each ORDER-gram's last symbol after the others, from what the model has said: sorted keys and their values."""

    def said(asked: np.ndarray, otherwise: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(asked), otherwise)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.where(keys[at] == asked, values[at], otherwise)

    p = np.full(len(grams), 1.0 / SYMBOLS)
    for n in range(1, ORDER + 1):
        end = grams & ((1 << BITS * n) - 1)
        p = said(n << 60 | end, 0.0) + said(-1 - (n << 60 | end >> BITS), 1.0) * p
    return p


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed differences, bytes of equal weight together."""
    steps = np.diff(keys, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(steps.T).tobytes())


def _unpack_keys(data: bytes) -> np.ndarray:
    steps = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(steps.T).view(np.int64).ravel())


def _pack_values(values: np.ndarray) -> bytes:
    """Shares and weights to a relative precision of a 4,096th, as 16 bits of their logarithms, bytes of equal weight together."""
    steps = np.minimum(np.round(-np.log(np.maximum(values, 1e-13)) * 2_048), 65_535).astype(np.uint16)
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 2).T).tobytes())


def _unpack_values(data: bytes) -> np.ndarray:
    steps = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(2, -1)
    return np.exp(np.ascontiguousarray(steps.T).view(np.uint16).ravel() / -2_048.0)


def _different(at: np.ndarray, owner: np.ndarray, many: int) -> np.ndarray:
    """For each text, the different n-grams (numbers) in consecutive windows of WINDOW characters, added up."""
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    since = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
    begins = since % WINDOW == 0
    rows = np.full((int(begins.sum()), WINDOW), -1, np.int32)
    rows[np.cumsum(begins) - 1, since % WINDOW] = at
    rows.sort(axis=1)
    found = (rows[:, 0] >= 0) + (rows[:, 1:] != rows[:, :-1]).sum(axis=1)
    return np.bincount(owner[begins], found, many).astype(np.int64)


class _Said:
    """What the model has said about a part: the costs of all ORDER-grams that it knows, worked out once; others are when they come."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = keys, values
        self.grams = keys[np.searchsorted(keys, ORDER << 60) :] & ((1 << BITS * ORDER) - 1)
        self.costs = self._cost(self.grams)

    def _cost(self, grams: np.ndarray) -> np.ndarray:
        return -np.log(np.maximum(probabilities(grams, self.keys, self.values), 1e-12))

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """Minus log probability of sorted ORDER-grams."""
        if not len(self.grams):
            return self._cost(grams)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        out, known = self.costs[at], self.grams[at] == grams
        out[~known] = self._cost(grams[~known])
        return out


def _packed(texts: pd.Series) -> pd.Series:
    pack = zstandard.ZstdCompressor(level=3)
    return texts.map(lambda t: pack.compress(t.encode("utf-8", "surrogatepass")))


def _squeeze():
    @F.pandas_udf("binary")
    def squeeze(texts: pd.Series) -> pd.Series:
        return _packed(texts)

    return squeeze


def _filter_of(ids: DataFrame):
    """A filter of bounded size: a bit for each id of `ids`, broadcast, and how many bits there are."""
    spark = ids.sparkSession
    bits = min(FILTER_BITS, max(1 << 15, 1 << max(0, 16 * ids.count() - 1).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(bits)) + 1  # Spark counts bits from 1 on
    # 4 KB for each 32768 bits, set by all tasks
    rows = ids.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    table = np.zeros(bits // 8, np.uint8)
    for r in rows:
        table[(r["bucket"] - 1) * 4_096 : r["bucket"] * 4_096] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(table), bits


def _maybe_in(ids: DataFrame, ident: Column):
    """A condition that holds for all rows with an id of `ids`, and for few others as long as these are at most an eighth of FILTER_BITS."""
    shared, bits = _filter_of(ids)

    @F.pandas_udf("boolean")
    def held(at: pd.Series) -> pd.Series:
        p = at.to_numpy(np.int64)
        return pd.Series((shared.value[p >> 3] >> (p & 7) & 1).astype(bool))

    return held(F.pmod(F.xxhash64(ident), F.lit(bits)))


def _squeezed_if_in(ids: DataFrame, ident: Column, text: Column) -> Column:
    """The compressed texts of rows of which _maybe_in() holds, null for the rest. One function, as two in a stage take two Python workers for each task."""
    shared, bits = _filter_of(ids)

    @F.pandas_udf("binary")
    def squeezed(at: pd.Series, texts: pd.Series) -> pd.Series:
        p = at.to_numpy(np.int64)
        held = (shared.value[p >> 3] >> (p & 7) & 1).astype(bool)
        out = np.full(len(texts), None, object)
        out[held] = _packed(texts[held])
        return pd.Series(out)

    # else Spark would work it out a second time for a filter on its result
    return squeezed.asNondeterministic()(F.pmod(F.xxhash64(ident), F.lit(bits)), text)


def train(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Languages with a model of their own (lang, mine), and the models of these and of POOLED, from the documents whose id is in trusted, but for one in KEPT_BACK."""
    bound_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        return _train(docs, trusted, id_col, text_col, lang_col)


def _train(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, DataFrame]:
    good = materialize(trusted.select(F.col(id_col).alias("id")).filter("id is not null").distinct(), "trusted")
    rows = docs.filter(F.length(text_col) > 0).select(F.col(id_col).alias("__id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.col(text_col).alias("__text"))
    # compressed texts move to their labels, at every size: ids of trusted documents are as many as the corpus makes them
    likely = rows.filter(F.col("__id").isNotNull()).select("__id", "lang", _squeezed_if_in(good, F.col("__id"), F.col("__text")).alias("packed")).filter("packed is not null")
    ours = likely.join(good.hint("merge"), F.col("__id") == F.col("id"), "left_semi")
    per_lang = rows.select("__id", "lang").join(good, F.col("__id") == F.col("id"), "left_semi").groupBy("lang").count()
    langs = materialize(per_lang.filter(F.col("count") >= LEAST_TRUSTED).orderBy(F.desc("count"), "lang").limit(MOST_LANGS).select("lang", F.lit(True).alias("mine")), "langs", keep=True)
    counted = ours.filter(~_kept_back(F.col("__id"))).select("lang", "packed").mapInPandas(_count, "lang string, gram long, c long")
    own = materialize(counted.groupBy("lang", "gram").agg(F.sum("c").alias("c")), "ngrams")
    pooled = own.groupBy("gram").agg(F.sum("c").alias("c")).select(F.lit(POOLED).alias("lang"), "gram", "c")
    return langs, kneser_ney(own.join(F.broadcast(langs.select("lang")), "lang", "left_semi").unionByName(pooled))


def _kept_back(ident: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("kept back"), ident), F.lit(KEPT_BACK)) == 0


def _prime(least: int) -> int:
    n = max(least, 3) | 1
    while any(n % k == 0 for k in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


def score(docs: DataFrame, langs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, print (a hash of the text), model_lang, n_scored (characters), nll (minus log probability in all) and n_different (different n-grams, in windows) for each row. A text moves once, compressed, to its part."""
    spark = docs.sparkSession
    text, tag = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(lang_col), F.lit(""))
    known = F.broadcast(langs.select(F.col("lang").alias("__tag"), "mine"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"), text.alias("text"), tag.alias("__lang")).join(known, F.col("__lang") == F.col("__tag"), "left")
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    parts = max(ceil(chars / PART_CHARS), min(partitions(spark), 8))
    shards = _prime(max(parts, partitions(spark)))
    named = rows.select("id", "print", F.when(F.col("mine"), F.col("__lang")).otherwise(F.lit(POOLED)).alias("lang"), _squeeze()("text").alias("packed"))
    # a part is a number that Spark's own hash deals to a task of its own
    least = spark.range(40 * parts).select(F.col("id").cast("int").alias("part")).groupBy(F.pmod(F.hash("part"), F.lit(parts)).alias("task")).agg(F.min("part").alias("part"))
    names = F.array(*[F.lit(r["part"]) for r in least.orderBy("task").collect()])
    dealt = named.withColumn("part", F.element_at(names, (F.pmod(F.xxhash64("id", "print"), F.size(names)) + 1).cast("int"))).repartition(parts, "part")

    def texts_of(packed: pd.Series) -> list[str]:
        swell = zstandard.ZstdDecompressor()
        return [swell.decompress(x).decode("utf-8", "surrogatepass") for x in packed]

    def ask(df: pd.DataFrame) -> pd.DataFrame:
        out = []
        for lang, of in df.groupby("lang"):
            counts = _Counts()
            for codes, _ in _slices(texts_of(of["packed"])):
                counts.add(codes)
            keys = _keys(counts.close()[0])
            shard = np.mod(keys, shards)
            order = np.argsort(shard, kind="stable")
            edge = np.searchsorted(shard[order], np.arange(shards + 1))
            out += [(lang, s, df["part"].iloc[0], _pack_keys(keys[order[a:b]])) for s, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)) if b > a]
        return pd.DataFrame(out, columns=["lang", "shard", "part", "keys"])

    def answer(model: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        at = np.argsort(model["key"].to_numpy(np.int64))
        keys, values = model["key"].to_numpy(np.int64)[at], model["value"].to_numpy(np.float32)[at]
        out = []
        for lang, part, packed in zip(asked["lang"], asked["part"], asked["keys"], strict=True) if len(keys) else ():
            wanted = _unpack_keys(packed)
            found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            there = keys[found] == wanted
            if there.any():
                out.append((part, lang, _pack_keys(wanted[there]), _pack_values(values[found[there]])))
        return pd.DataFrame(out, columns=["part", "lang", "keys", "values"])

    def scored(df: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        out = []
        for lang, of in df.groupby("lang"):
            own = said[said["lang"] == lang]
            keys = np.concatenate([np.zeros(0, np.int64), *map(_unpack_keys, own["keys"])])
            values = np.concatenate([np.zeros(0), *map(_unpack_values, own["values"])])
            order = np.argsort(keys)
            model = _Said(keys[order], values[order])
            texts = texts_of(of["packed"])
            nll, different = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for codes, owner in _slices(texts):
                grams, at = np.unique(codes, return_inverse=True)
                nll += np.bincount(owner, model.cost(grams)[at], len(texts))
                different += _different(at, owner, len(texts))
            out.append(pd.DataFrame({"id": of["id"], "print": of["print"], "model_lang": lang, "n_scored": np.array([len(t) for t in texts], np.int64), "nll": nll, "n_different": different}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "print": [], "model_lang": [], "n_scored": [], "nll": [], "n_different": []})

    asked = dealt.groupBy("part").applyInPandas(ask, "lang string, shard int, part int, keys binary")
    code = F.when(F.col("code") >= 0, F.col("code")).otherwise(-1 - F.col("code"))
    key = F.shiftleft(F.col("n").cast("long"), 60).bitwiseOR(code)
    key = F.when(F.col("code") >= 0, key).otherwise(-1 - key)
    held = model.select("lang", key.alias("key"), F.col("value").cast("float").alias("value")).withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
    answers = held.groupBy("lang", "shard").cogroup(asked.groupBy("lang", "shard")).applyInPandas(answer, "part int, lang string, keys binary, values binary")
    return dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(scored, f"id {kind}, print long, model_lang string, n_scored long, nll double, n_different long")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, margin: float = MARGIN, low_quantile: float = LOW_QUANTILE, low_margin: float = LOW_MARGIN) -> DataFrame:
    """doc_id, print, model_lang, n_scored, perplexity, score, threshold, variety, least_variety and accepted for each row of docs.

    Trusted are the documents with quality 1 in labels. score is the log-perplexity, smoothed by PRIOR_CHARS characters at the mean of the language's trusted text; a row is rejected if it exceeds
    the quantile of the language's kept-back trusted documents by more than the margin. variety is the share of different n-grams in windows of WINDOW characters, smoothed likewise; a row is rejected if it falls
    short of their low quantile by more than the low margin. Null and empty texts are rejected, with a null perplexity. Null and rare languages share the pooled model. Rows that repeat an id are scored each. Without any trusted text nothing but empty texts is rejected.
    """
    with scratch(docs.sparkSession):
        return _classified(docs, labels.filter("quality = 1"), id_col, text_col, lang_col, quantile, margin, low_quantile, low_margin)


def _classified(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, lang_col: str, quantile: float, margin: float, low_quantile: float, low_margin: float) -> DataFrame:
    langs, model = train(docs, trusted, id_col, text_col, lang_col)
    rows = materialize(score(docs, langs, model, id_col, text_col, lang_col), "scores", keep=True)
    good = trusted.select(F.col(id_col).alias("__t")).distinct()
    known = rows.filter("n_scored > 0").join(good, F.col("id") == F.col("__t"), "left_semi")
    # where a language has too few documents kept back, all of its trusted ones count
    back = _kept_back(F.col("id"))
    means = known.groupBy("model_lang").agg((F.sum("nll") / F.sum("n_scored")).alias("mean"), (F.sum("n_different") / F.sum("n_scored")).alias("usual"), (F.count_if(back) < 5).alias("few"))
    means = materialize(means, "means", keep=True)

    def smoothed(df: DataFrame) -> DataFrame:
        # at most MOST_LANGS languages and the pooled one
        both = df.join(F.broadcast(means), "model_lang", "left")
        with_prior = lambda total, mean: (F.col(total) + PRIOR_CHARS * F.coalesce(mean, F.lit(0.0))) / (F.col("n_scored") + PRIOR_CHARS)
        return both.withColumns({"score": with_prior("nll", "mean"), "variety": with_prior("n_different", "usual")})

    judged = smoothed(known).filter(back | F.col("few")).groupBy("model_lang")
    limits = judged.agg((F.percentile_approx("variety", low_quantile, 100_000) - low_margin).alias("least_variety"), (F.percentile_approx("score", quantile, 100_000) + margin).alias("threshold"))
    done = smoothed(rows).join(F.broadcast(materialize(limits, "limits", keep=True)), "model_lang", "left")
    perplexity = F.when(F.col("n_scored") > 0, F.exp(F.col("nll") / F.greatest("n_scored", F.lit(1))))
    accepted = (F.col("n_scored") > 0) & (F.col("score") <= F.coalesce("threshold", F.lit(float("inf")))) & (F.col("variety") >= F.coalesce("least_variety", F.lit(0.0)))
    return done.select(F.col("id").alias("doc_id"), "print", "model_lang", "n_scored", perplexity.alias("perplexity"), "score", "threshold", "variety", "least_variety", accepted.alias("accepted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that classify() accepts, unchanged."""
    bad = classify(docs, labels, id_col, text_col, lang_col).filter("not accepted").select(F.col("doc_id").alias("__id"), F.col("print").alias("__p")).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__p")), "left_anti")
