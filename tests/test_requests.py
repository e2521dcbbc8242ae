"""Requests at once, limits over batches, workers and processes, failures by row, answers asked for once."""

import json
import multiprocessing
import os
import threading
import time

import pytest

from weftgraph.operators.registry import Registry
from weftgraph.plans.answers import answered, call_metrics
from weftgraph.plans.ingest import Ingest
from weftgraph.plans.models import BatchVerifier, Embedder, Extractor, HashingEmbedder, PatternExtractor, PromptExtractor, RateLimited, SlidingWindow, embed_column, extract_triples, with_retries
from weftgraph.plans.requests import Book, BudgetServer, ask_many, factory_key, of_process


def test_many_at_once_in_order():
    under_way, most, lock = [0], [0], threading.Lock()

    def slow(x):
        with lock:
            under_way[0] += 1
            most[0] = max(most[0], under_way[0])
        time.sleep(0.1)
        with lock:
            under_way[0] -= 1
        if x == 7:
            raise ValueError("seven")
        return x

    began = time.time()
    got = list(ask_many(range(40), slow, 10))
    assert time.time() - began < 1.0 and most[0] == 10
    assert [a.value for a in got if not a.error] == [x for x in range(40) if x != 7] and str(got[7].error) == "seven"
    taken = []

    def items():
        for x in range(1000):
            taken.append(x)
            yield x

    answers = ask_many(items(), lambda x: x, 4)
    next(answers)
    assert len(taken) <= 9  # items are taken as answers are given away
    assert [a.value for a in answers] == list(range(1, 1000))


def test_one_failure_costs_one_row(spark):
    class Fussy(Extractor):
        at_once, request_texts = 4, 8

        def extract(self, texts):
            if "bad" in texts:
                raise ValueError("bad text")
            return [[{"n": t}] for t in texts]

    texts = [f"t{i}" for i in range(40)]
    texts[21] = "bad"
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, chunk string").coalesce(1)
    got = extract_triples(chunks, Fussy, permissive=True).orderBy("i").collect()
    assert [r["i"] for r in got if r["error"]] == [21] and got[21]["answer"] == "[]" and got[21]["error"] == "bad text"
    assert all(json.loads(r["answer"]) == [{"n": r["chunk"]}] for r in got if r["i"] != 21)


def test_prompts_run_at_once(spark):
    def make():
        def complete(prompt):
            time.sleep(0.1)
            return json.dumps([{"n": prompt[-2:]}])

        return PromptExtractor(complete, at_once=16)

    chunks = spark.createDataFrame([(i, f"text {i:02d}") for i in range(32)], "i int, chunk string").coalesce(1)
    extract_triples(chunks.limit(1), make).collect()
    began = time.time()
    got = extract_triples(chunks, make).orderBy("i").collect()
    assert time.time() - began < 2.5 and [json.loads(r["answer"])[0]["n"] for r in got] == [f"{i:02d}" for i in range(32)]


def test_embedding_requests_are_repeated_when_refused(spark, tmp_path):
    folder = str(tmp_path)

    class Refuses(Embedder):
        max_batch_size, at_once = 4, 2

        def embed(self, texts):
            name = os.path.join(folder, texts[0])
            if not os.path.exists(name):
                open(name, "w").close()
                raise RateLimited
            return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(20)], "i int, t string").coalesce(1)
    quick = lambda call: with_retries(call, base_seconds=0.0)
    assert [r["embedding"] for r in embed_column(rows, "t", Refuses, retry=quick).orderBy("i").collect()] == [[float(i + 1)] for i in range(20)]
    assert len(os.listdir(folder)) == 5


def test_a_limiter_goes_on_over_batches_and_tasks(spark, tmp_path):
    """30 batches of a verifier whose limit is 10 requests in 2 seconds, one worker: no window has more, and it takes its time."""
    log = str(tmp_path / "calls")

    def judge():
        def ask(rows):
            with open(log, "a") as out:
                out.write(f"{time.time()}\n")
            return [None] * len(rows)

        return ask

    pairs = spark.createDataFrame([(f"s{i}", f"d{i}", None, 0.9, "a b c", "a b c", "x", "y") for i in range(30)], "src string, dst string, ref long, similarity double, name string, description string, other_name string, other_description string")
    pairs = pairs.coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        verifier = BatchVerifier(judge, budget=8, reserve=0, limiter=lambda: SlidingWindow(10, 1_000_000, window_seconds=2.0), at_once=3)
        assert len(verifier.verify(pairs).collect()) == 30
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    calls = sorted(float(x) for x in open(log))
    assert len(calls) == 30 and calls[-1] - calls[0] >= 3.9
    assert max(sum(1 for c in calls if a <= c < a + 1.95) for a in calls) <= 10


def test_of_process():
    make = lambda: object()
    assert of_process(factory_key(make), make) is of_process(factory_key(make), make)


def test_book():
    now = [0.0]
    book = Book(rpm=10, tpm=100, window_seconds=60, lease_seconds=5, max_concurrent=2, clock=lambda: now[0])
    a = book.take(8, 10)
    assert (a["requests"], a["tokens"]) == (8, 80)
    assert book.take(8, 30)["wait"] == 65  # 20 tokens are left
    b = book.take(8, 10)
    assert (b["requests"], b["tokens"]) == (2, 20) and "wait" in book.take(1, 0)
    book.give_back(a["lease"], 6, 60)
    c = book.take(8, 5)
    assert (c["requests"], c["tokens"]) == (6, 40)
    now[0] = 64.9
    assert "wait" in book.take(1, 1)
    now[0] = 65.0
    assert book.take(1, 500)["tokens"] == 500  # above the whole budget: alone
    assert "wait" in book.take(1, 1)
    assert book.enter(1) == book.enter(2) == {} and "wait" in book.enter(1)
    book.gone(1)
    assert book.enter(3) == {}


def _works(make, log, kill):
    limit = make()
    for n in range(1000):
        with limit.slot(1):
            with open(log, "a") as out:
                out.write(f"{time.time()}\n")
            if kill and n == 3:
                os.kill(os.getpid(), 9)
            time.sleep(0.005)


def test_one_budget_for_all_workers(tmp_path):
    """Four processes, one of which is killed within a request: no window has more calls than the budget, and the others go on."""
    server = BudgetServer(Book(rpm=30, tpm=1_000, window_seconds=2.0, lease_seconds=0.3, max_concurrent=3))
    context, log = multiprocessing.get_context("fork"), str(tmp_path / "calls")
    workers = [context.Process(target=_works, args=(server.limiter(4), log, i == 0)) for i in range(4)]
    for w in workers:
        w.start()
    time.sleep(7)
    for w in workers:
        w.kill()
        w.join()
    time.sleep(0.2)
    assert not server.book.running
    server.close()
    calls = sorted(float(x) for x in open(log))
    assert max(sum(1 for c in calls if a <= c < a + 2.0) for a in calls) <= 30
    assert len(calls) > 60 and calls[-1] - calls[0] > 4


def test_workers_of_spark_share_a_budget(spark, tmp_path):
    log = str(tmp_path / "calls")
    server = BudgetServer(Book(rpm=8, tpm=10_000, window_seconds=1.5, lease_seconds=0.3))

    class Logs(HashingEmbedder):
        max_batch_size = 1

        def embed(self, texts):
            with open(log, "a") as out:
                out.write(f"{time.time()}\n")
            return super().embed(texts)

    rows = spark.createDataFrame([(i, f"text {i}") for i in range(32)], "i int, t string").repartition(4)
    assert embed_column(rows, "t", Logs, limiter=server.limiter(2)).filter("size(embedding) > 0").count() == 32
    server.close()
    calls = sorted(float(x) for x in open(log))
    assert len(calls) >= 32 and max(sum(1 for c in calls if a <= c < a + 1.5) for a in calls) <= 8


# answers by content


def test_answers_are_asked_for_once(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "r")).create()
    asked = []

    def ask(texts):
        rows = texts.collect()
        asked.append(sorted(r["t"] for r in rows))
        if len(asked) == 2:
            raise OSError("broken in the middle")
        return spark.createDataFrame([(r["digest"], r["t"].upper() if r["t"] != "c" else None, None if r["t"] != "c" else "no") for r in rows], "digest string, answer string, error string")

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "a", "c", None, "d", "e", "f"])], "i int, t string")
    with pytest.raises(OSError):
        answered(rows, "t", "m", registry, ask, "answer", wave_rows=2)
    first = asked[0]
    got = {r["i"]: (r["answer"], r["error"]) for r in answered(rows, "t", "m", registry, ask, "answer", wave_rows=100).collect()}
    assert not set(first) & set(asked[2]) - {"c"} and sorted({*first, *asked[2]}) == list("abcdef")
    assert got == {0: ("A", None), 1: ("B", None), 2: ("A", None), 3: (None, "no"), 4: (None, None), 5: ("D", None), 6: ("E", None), 7: ("F", None)}
    answered(rows, "t", "m", registry, ask, "answer").collect()
    assert asked[3] == ["c"]  # only what failed is asked for again
    answered(rows, "t", "other model", registry, ask, "answer").collect()
    assert asked[4] == list("abcdef")


def test_the_same_documents_again_ask_for_nothing(spark, tmp_path):
    """A first run embeds each object once; the same documents again extract and embed nothing, and write no part of the objects' tables."""
    log, asks = str(tmp_path / "texts"), {}

    class Embeds(HashingEmbedder):
        def embed(self, texts):
            with open(log, "a") as out:
                out.writelines(f"{t}\n" for t in texts)
            return super().embed(texts)

    class Extracts(PatternExtractor):
        def extract(self, texts):
            with open(log + ".chunks", "a") as out:
                out.writelines(f"{t}\n" for t in texts)
            return super().extract(texts)

    registry = Registry(spark, str(tmp_path / "r"))
    docs = spark.createDataFrame([("a.txt", "Octavian is part of Rome. Rome is located in Italy.", "txt"), ("b.txt", "Octavian is part of Rome. Gaul is part of Rome.", "txt")], "uri string, content string, file_type string")
    for run in range(3):
        ingest = Ingest(spark, registry, embedder=Embeds)
        ingest.extractor = Extracts
        linked = ingest.run(docs if run < 2 else docs.filter("uri = 'b.txt'"))
        assert linked.filter("from_entity_reference is null").count() == 0
        asks[run] = [sorted(open(f)) if os.path.exists(f) else [] for f in (log, log + ".chunks")]
        parts = {t: [p.path for p in registry.parts(t)] for t in ("entities", "relationship_types")}
        if run:
            assert parts == before
        before = parts
    assert len(asks[0][0]) == len(set(asks[0][0])) == 6 and len(asks[0][1]) == 2
    assert asks[1] == asks[0] and asks[2] == asks[0]


def test_what_calls_cost_is_counted_once(spark, tmp_path):
    """One row for each run, right also where a request is refused and repeated, and where one fails."""
    folder = str(tmp_path)

    class Busy(Extractor):
        request_texts = 4

        def extract(self, texts):
            name = os.path.join(folder, f"asked-{len(texts)}-{texts[0][:2]}")
            if not os.path.exists(name):
                open(name, "w").close()
                raise RateLimited
            if any(t.startswith("bad") for t in texts):
                raise ValueError("bad text")
            return [[] for _ in texts]

    registry = Registry(spark, str(tmp_path / "r")).create()
    rows = spark.createDataFrame([(i, f"t{i} two words" if i != 5 else "bad text") for i in range(8)], "i int, chunk string")
    quick = lambda call: with_retries(call, base_seconds=0.0)
    ask = lambda texts: extract_triples(texts.coalesce(1), Busy, permissive=True, retry=quick)
    for run in ("one", "two"):
        answered(rows, "chunk", "m", registry, ask, "answer", run=run).collect()
    got = {r["run"]: r.asDict() for r in call_metrics(registry).collect()}
    first = got["one"]
    assert first["texts"] == 8 and first["errors"] == 1 and first["seconds"] > 0
    # two requests of four, each refused once; the four texts of the one with the bad text one by one, each refused once
    assert (first["requests"], first["refusals"]) == (4 + 8, 2 + 4)
    assert got["two"]["texts"] == 1 and got["two"]["errors"] == 1 and got["two"]["requests"] == 1
    docs = spark.createDataFrame([("a.txt", "Octavian is part of Rome.", "txt")], "uri string, content string, file_type string")
    Ingest(spark, registry).run(docs, "stream:1")
    assert {r["run"]: r["requests"] for r in call_metrics(registry).collect()}["stream:1"] == 1
