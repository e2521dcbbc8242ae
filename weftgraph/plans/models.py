"""Models behind interfaces: extractors, embedders and verifiers, with offline ones that always say the same."""

from __future__ import annotations

import hashlib
import json
import random
import re
import threading
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftgraph.functions.text import SENTENCE_GAP, token_count
from weftgraph.operators import batching, resolution
from weftgraph.plans.requests import SharedLimiter, ask_many, factory_key, of_process, slot_of
from weftgraph.plans.staging import materialize
from weftgraph.schemas import TRIPLE_FIELDS

# The fields that an extractor is asked for, and the kinds of statements.
EXTRACTION_PROMPT = (
    "List the statements of the text as JSON objects with the fields " + ", ".join(TRIPLE_FIELDS[:-1]) + ". "
    "A statement relates a universal to a universal, an instance to a universal, or an instance to an instance."
)


class RateLimited(Exception):
    """A model's answer that it is asked too often."""


def with_retries(call: Callable[[], object], attempts: int = 5, base_seconds: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """What call returns; after RateLimited it is tried again, each time after twice as long, other errors pass."""
    for n in range(attempts):
        try:
            return call()
        except RateLimited:
            if n + 1 == attempts:
                raise
            sleep(base_seconds * 2**n)
    raise ValueError("attempts must be positive")


@dataclass
class SlidingWindow:
    """Requests and tokens of one Python process within a window, and how many run at once; its threads may share it. A budget of all workers is a BudgetServer's. One clock for all."""

    rpm: int
    tpm: int
    window_seconds: float = 60.0
    max_concurrent: int = 40
    jitter_seconds: float = 0.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    seed: int = 0
    running: int = 0
    calls: list[tuple[float, int]] = field(default_factory=list)
    lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "lock"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, lock=threading.Lock())

    def wait_for(self, tokens: int) -> float:
        """Seconds until a call of so many tokens would be admitted; 0 for now."""
        now = self.clock()
        self.calls = [c for c in self.calls if c[0] > now - self.window_seconds]
        used = sum(c[1] for c in self.calls)
        if len(self.calls) < self.rpm and used + tokens <= self.tpm and self.running < self.max_concurrent:
            return 0.0
        if not self.calls:
            return 0.05 if self.running >= self.max_concurrent else 0.0  # a call above the whole limit goes alone
        if self.running >= self.max_concurrent:
            return 0.05  # until one under way is done
        drop, left = 0.0, len(self.calls)
        for at, cost in self.calls:
            drop, used, left = at + self.window_seconds - now, used - cost, left - 1
            if left < self.rpm and (used + tokens <= self.tpm or not left):
                break
        return max(drop, 1e-3) + random.Random(self.seed + len(self.calls)).random() * self.jitter_seconds

    @contextmanager
    def slot(self, tokens: int) -> Iterator[None]:
        """Waits for admission; what was taken is given back only if it was."""
        while True:
            with self.lock:
                if not (wait := self.wait_for(tokens)):
                    self.calls.append((self.clock(), tokens))
                    self.running += 1
                    break
            self.sleep(wait)
        try:
            yield
        finally:
            with self.lock:
                self.running -= 1


class Extractor(ABC):
    """Triples of texts. One instance is made for each Python process, so clients and limiters are shared by its tasks. What is asked of it at once, from several threads, is at_once requests of request_texts texts each."""

    at_once: int = 1
    request_texts: int = 1

    @abstractmethod
    def extract(self, texts: list[str]) -> list[list[dict]]:
        """A list of triples for each text."""


class PromptExtractor(Extractor):
    """A model behind a function from a prompt to the JSON of a chunk's triples; each request waits for `limiter`."""

    def __init__(self, complete: Callable[[str], str], limiter: SlidingWindow | SharedLimiter | None = None, count: Callable[[str], int] = lambda t: len(t.split()), at_once: int = 16) -> None:
        self.complete, self.limiter, self.count, self.at_once = complete, limiter, count, at_once

    def extract(self, texts: list[str]) -> list[list[dict]]:
        out = []
        for prompt in map(extraction_prompt, texts):
            with slot_of(self.limiter, self.count(prompt)):
                out.append(json.loads(self.complete(prompt)))
        return out


class PatternExtractor(Extractor):
    """Sentences of the form <subject> <verb> <object>, with a verb of a small list."""

    VERBS = ("is part of", "is located in", "supplies", "owns", "competes with", "is a", "causes")

    def extract(self, texts: list[str]) -> list[list[dict]]:
        verbs = "|".join(map(re.escape, self.VERBS))
        out = []
        for text in texts:
            found = []
            for sentence in re.split(SENTENCE_GAP, text or ""):
                m = re.match(rf"^\s*(.+?)\s+({verbs})\s+(.+?)[.!?]*\s*$", sentence)
                if m:
                    a, verb, b = m.groups()
                    found.append(dict(zip(TRIPLE_FIELDS, (a, a, b, b, verb, verb, "", sentence.strip(), verb == "causes", None), strict=True)))
            out.append(found)
        return out


class Embedder(ABC):
    """Vectors of texts, one instance for each Python process, asked from at_once threads. A request has at most max_batch_size texts and, unless it has one, max_batch_tokens tokens; texts are cut to max_tokens words (0: not)."""

    at_once: int = 1
    max_batch_size: int = 128
    max_batch_tokens: int = 120_000
    max_tokens: int = 0
    dimensions: int = 0
    #: What is put before a text of a kind ("document" or "query").
    prefixes: dict[str, str] = {}

    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float]]:
        """A vector for each text; empty for a blank one."""


class HashingEmbedder(Embedder):
    """Signed counts of lower-case words and pairs of words in buckets, of unit length."""

    def __init__(self, dimensions: int = 256, max_tokens: int = 0) -> None:
        self.dimensions, self.max_tokens = dimensions, max_tokens

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            words = (text or "").lower().split()
            v = np.zeros(self.dimensions)
            for gram in words + [" ".join(p) for p in zip(words, words[1:], strict=False)]:
                h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little")
                v[h % self.dimensions] += 1 if h >> 63 else -1
            size = np.linalg.norm(v)
            out.append((v / size).astype(np.float32).tolist() if size else [])
        return out


class Verifier(ABC):
    """Whether the two objects of a pair are one."""

    @abstractmethod
    def verify(self, pairs: DataFrame) -> DataFrame:
        """pairs (name, description, other_name, other_description, similarity, ...) with are_same, updated_name and updated_description."""


def _bare(column: str) -> Column:
    """A name in lower case without white space at its ends."""
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))


class BatchVerifier(Verifier):
    """A model that judges pairs in batches of a token budget: `judge` makes, once in each Python process, what turns a list of pairs (as dicts) into a list of answers (are_same, updated_name,
    updated_description; None: no answer, so not the same). Each request waits for `limiter` and is repeated when it is refused; at_once of a worker run at the same time."""

    COLUMNS = ("name", "description", "other_name", "other_description")

    def __init__(self, judge: Callable[[], Callable[[list[dict]], list[dict | None]]], count: Callable[[str], int] | None = None, budget: int = 4_000, reserve: int = 500, limiter: Callable[[], SlidingWindow | SharedLimiter] | None = None, retry: Callable = with_retries, at_once: int = 1) -> None:
        self.judge, self.count, self.budget, self.reserve, self.limiter, self.retry, self.at_once = judge, count, budget, reserve, limiter, retry, at_once

    def verify(self, pairs: DataFrame) -> DataFrame:
        order = [c for c in ("src", "dst", "ref", *self.COLUMNS) if c in pairs.columns]
        cost = reduce(add, [token_count(F.col(c), self.count) for c in self.COLUMNS])
        packed = materialize(batching.verification_batches(pairs.withColumn("__tokens", cost), "__tokens", self.budget, self.reserve, order).withColumn("pair_id", F.monotonically_increasing_id()), "pairs")
        judge, limiter, retry, columns, at_once = self.judge, self.limiter, self.retry, list(self.COLUMNS), self.at_once
        keys = factory_key(judge), factory_key(limiter) if limiter else ""

        def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ask, limit = of_process(keys[0], judge), of_process(keys[1], limiter) if limiter else None

            def answers(df: pd.DataFrame) -> pd.DataFrame:
                rows = df[columns].to_dict("records")
                with slot_of(limit, int(df["__tokens"].sum())):
                    told = retry(lambda: ask(rows))
                rows = [(i, *(a.get(k) for k in ("are_same", "updated_name", "updated_description"))) for i, a in zip(df["pair_id"], told, strict=True) if a]
                return pd.DataFrame(rows, columns=["pair_id", "are_same", "updated_name", "updated_description"])

            for done in ask_many(_whole_groups(batches, "batch_no"), answers, at_once):
                if done.error:
                    raise done.error
                yield done.value

        dealt = packed.repartition("batch_no").sortWithinPartitions("batch_no")
        verdicts = dealt.mapInPandas(asked, "pair_id long, are_same boolean, updated_name string, updated_description string")
        return resolution.merge_verdicts(packed, verdicts, ("pair_id",)).drop("__tokens", "batch_no", "pair_id")


def _whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The rows of each value of key, of rows sorted by it; a value that goes on in the next Arrow batch is put together."""
    rest = None
    for df in batches:
        df = df if rest is None else pd.concat([rest, df], ignore_index=True)
        groups = [g for _, g in df.groupby(key, sort=False)]
        rest = groups.pop() if groups else None
        yield from groups
    if rest is not None:
        yield rest


class RuleVerifier(Verifier):
    """The same if the names are, but for case and ends, or the similarity is at least tau. The longer name stays (of equal ones the lesser), and both descriptions if they differ."""

    def __init__(self, tau: float = 0.95) -> None:
        self.tau = tau

    def verify(self, pairs: DataFrame) -> DataFrame:
        same = (_bare("name") == _bare("other_name")) | (F.col("similarity") >= self.tau)
        n, m = F.length("name"), F.length("other_name")
        name = F.when(n > m, F.col("name")).when(m > n, F.col("other_name")).otherwise(F.least("name", "other_name"))
        both = F.when(F.col("description").eqNullSafe(F.col("other_description")), F.col("description")).otherwise(F.concat_ws("; ", "description", "other_description"))
        same = F.coalesce(same, F.lit(False))
        return pairs.withColumns({"are_same": same, "updated_name": F.when(same, name), "updated_description": F.when(same, both)})


def extraction_prompt(text: str) -> str:
    """What a model is told to do with a chunk."""
    return f"{EXTRACTION_PROMPT}\n\n{text}"


def extract_triples(chunks: DataFrame, make: Callable[[], Extractor] = PatternExtractor, text_col: str = "chunk", permissive: bool = False, retry: Callable = with_retries) -> DataFrame:
    """chunks with answer, the JSON of each chunk's triples, error and call. Requests of a worker run at once as far as its extractor says, in the order of the rows. An extractor that fails is an error; with permissive the answer of the
    chunk that it failed on is "[]" and the error is in the column error: where a request of several texts fails, they are asked for one by one. call has, on the first row of each request, the requests, words, seconds and refusals that
    it took, else it is null."""
    names = [c for c in chunks.columns if c not in ("answer", "error", "call")]
    schema = StructType([*chunks.select(*names).schema.fields, *StructType.fromDDL("answer string, error string, call struct<requests: long, tokens: long, seconds: double, refusals: long>").fields])
    key = factory_key(make)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor = of_process(key, make)
        size = max(1, extractor.request_texts)

        def told(texts: list[str]) -> list[tuple[str, str | None, dict | None]]:
            call, began = {"requests": 0, "tokens": 0, "seconds": 0.0, "refusals": 0}, time.monotonic()

            def once() -> list:
                call["requests"] += 1
                call["tokens"] += sum(len((t or "").split()) for t in texts)
                try:
                    return extractor.extract(texts)
                except RateLimited:
                    call["refusals"] += 1
                    raise

            try:
                answers, failed = retry(once), None
                if len(answers) != len(texts):
                    raise ValueError(f"{len(answers)} answers to {len(texts)} texts")
            except Exception as wrong:
                if not permissive:
                    raise
                answers, failed = [[]] * len(texts), wrong
            call["seconds"] = time.monotonic() - began
            if failed and len(texts) > 1:  # one by one, beside what the request for all has cost
                rows = [row for t in texts for row in told([t])]
                rows[0][2].update({k: rows[0][2][k] + v for k, v in call.items()})
                return rows
            return [(json.dumps(t), str(failed) if failed else None, call if i == 0 else None) for i, t in enumerate(answers)]

        for df in batches:
            texts = df[text_col].tolist()
            rows: list[tuple[str, str | None, dict | None]] = []
            for done in ask_many((texts[at : at + size] for at in range(0, len(texts), size)), told, extractor.at_once):
                if done.error:
                    raise done.error
                rows += done.value
            yield df.assign(answer=[r[0] for r in rows], error=[r[1] for r in rows], call=[r[2] for r in rows])

    return chunks.select(*names).mapInPandas(run, schema)


def request_batches(texts: list[str], most_texts: int, most_tokens: int, count: Callable[[str], int]) -> Iterator[tuple[int, int, int]]:
    """Where the requests for texts begin and end, and their tokens."""
    begin, used = 0, 0
    for i, text in enumerate(texts):
        cost = count(text)
        if i > begin and (i - begin == most_texts or used + cost > most_tokens):
            yield begin, i, used
            begin, used = i, 0
        used += cost
    if begin < len(texts):
        yield begin, len(texts), used


def embed_column(rows: DataFrame, text_col: str, make: Callable[[], Embedder] = HashingEmbedder, out_col: str = "embedding", kind: str = "document", limiter: Callable[[], SlidingWindow | SharedLimiter] | None = None, retry: Callable = with_retries) -> DataFrame:
    """rows with a vector of a text column, asked for in requests of the embedder's size, as many at once as it says, each after waiting for `limiter` and again when it is refused. Vectors that rows have already (out_col not null or
    empty) stay and aren't asked for. The embedder and the limiter are made once in each Python process."""
    keys = factory_key(make), factory_key(limiter) if limiter else ""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder, limit = of_process(keys[0], make), of_process(keys[1], limiter) if limiter else None
        prefix = embedder.prefixes.get(kind, "")
        for texts in batches:
            out: list = [[]] * len(texts)
            wanted = [i for i, t in enumerate(texts) if t and t.strip()]
            ready = [prefix + (" ".join(t.split()[: embedder.max_tokens]) if embedder.max_tokens else t) for t in texts.iloc[wanted]]

            def ask(request: tuple[int, int, int], ready: list[str] = ready) -> tuple[int, int, list]:
                a, b, tokens = request

                def once() -> list:
                    with slot_of(limit, tokens):
                        return embedder.embed(ready[a:b])

                return a, b, retry(once)

            for done in ask_many(request_batches(ready, embedder.max_batch_size, embedder.max_batch_tokens, lambda t: len(t.split())), ask, embedder.at_once):
                if done.error:
                    raise done.error
                a, b, made = done.value
                for i, v in zip(wanted[a:b], made, strict=True):
                    if embedder.dimensions and len(v) not in (0, embedder.dimensions):
                        raise ValueError(f"a vector of {len(v)} dimensions, not {embedder.dimensions}")
                    out[i] = v
            yield pd.Series(out, dtype=object)

    if out_col not in rows.columns:
        return rows.withColumn(out_col, vectors(F.col(text_col)))
    have = F.coalesce(F.size(out_col) > 0, F.lit(False))
    return rows.withColumn(out_col, F.when(have, F.col(out_col)).otherwise(vectors(F.when(~have, F.col(text_col)))))


#: Extractors by name; an unknown name is an error before any work begins.
EXTRACTORS: dict[str, Callable[[], Extractor]] = {"pattern": PatternExtractor}


def extractor_named(name: str) -> Callable[[], Extractor]:
    if name not in EXTRACTORS:
        raise ValueError(f"unknown extractor {name!r}; known are {', '.join(sorted(EXTRACTORS))}")
    return EXTRACTORS[name]
