import pytest
from weftgraph.operators.registry import Registry
import json

from pyspark.sql import functions as F

from weftgraph.operators import triples
from weftgraph.operators.registry import Conflict
from weftgraph.plans import staging
from weftgraph.plans.ingest import Ingest, Settings, all_ok, health
from weftgraph.plans.models import BatchVerifier, Embedder, Extractor, HashingEmbedder, PatternExtractor, PromptExtractor, RateLimited, SlidingWindow, embed_column, extract_triples, request_batches, with_retries
from weftgraph.sources.documents import read_documents
from weftgraph.streaming.ingest import ingest_stream, stream_documents

DOCS = {"a.txt": "Octavian is part of Rome. Rome is located in Italy.", "b.MD": "Octavian is part of Rome. Nothing here!", "c.txt": "Octavian is part of Rome. Rome is located in Italy.", "d.pdf": "Rome owns Gaul."}


@pytest.fixture
def folder(tmp_path):
    for name, content in DOCS.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(content)
    (tmp_path / "in" / "e.txt").write_bytes(b"\xff\xfe broken")
    return tmp_path


def state(registry):
    return {t: registry.table(t).count() for t in ("entities", "relationship_types", "relationships", "nodes", "edges")}


def test_documents_twice(spark, folder):
    registry = Registry(spark, str(folder / "registry"))
    ingest = Ingest(spark, registry)
    docs = read_documents(spark, str(folder / "in") + "/")
    assert sorted(r["file_type"] for r in docs.collect()) == ["MD", "txt", "txt"]
    linked = ingest.run(docs)
    assert linked.count() == 3 and linked.filter("from_entity_reference is null").count() == 0
    first = state(registry)
    assert first == {"entities": 3, "relationship_types": 2, "relationships": 3, "nodes": 3, "edges": 3}
    again = Ingest(spark, registry).run(docs)
    second = state(registry)
    assert {t: second[t] for t in ("entities", "relationship_types", "nodes")} == {t: first[t] for t in ("entities", "relationship_types", "nodes")}
    refs = lambda df: {(r["from_entity"], r["from_entity_reference"]) for r in df.collect()}
    assert refs(again) == refs(linked)
    assert {r["state"] for r in health(spark, registry).collect()} == {"OK"}
    assert registry.preview("entities").first()["id"] == 1
    registry.wipe()
    assert set(state(registry).values()) == {0}


def test_stream(spark, folder):
    registry = Registry(spark, str(folder / "registry"))
    ingest = Ingest(spark, registry)
    for _ in range(2):
        ingest_stream(stream_documents(spark, str(folder / "in"), 2), ingest, str(folder / "checkpoint")).awaitTermination(120)
    assert state(registry) == {"entities": 3, "relationship_types": 2, "relationships": 3, "nodes": 3, "edges": 3}


def test_failures_are_errors_unless_asked_for(spark):
    class Failing(Extractor):
        def extract(self, texts):
            raise ValueError("no model")

    chunks = spark.createDataFrame([("u", "x")], "uri string, chunk string")
    row = extract_triples(chunks, Failing, permissive=True).first()
    assert row["answer"] == "[]" and row["error"] == "no model"
    with pytest.raises(Exception, match="no model"):
        extract_triples(chunks, Failing).collect()


def test_unknown_extractor_fails_at_once(spark, tmp_path):
    with pytest.raises(ValueError):
        Ingest(spark, Registry(spark, str(tmp_path)), Settings(extractor="other"))


def test_retries():
    waits, answers = [], iter([RateLimited(), RateLimited(), 7])

    def call():
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert with_retries(call, sleep=waits.append) == 7 and waits == [30.0, 60.0]
    with pytest.raises(ValueError):
        with_retries(lambda: int("x"), sleep=waits.append)


def test_sliding_window():
    now = [0.0]
    limit = SlidingWindow(rpm=2, tpm=100, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(2):
        with limit.slot(10):
            pass
    assert now[0] == 0
    with limit.slot(10):
        assert now[0] == pytest.approx(60)
    with limit.slot(95):
        assert now[0] == pytest.approx(120)
    assert limit.running == 0


def test_pattern_extractor():
    (found,) = PatternExtractor().extract(["Smoke causes fog. Why?"])
    assert found[0]["from_entity"] == "Smoke" and found[0]["is_causal"] is True and len(found) == 1


def test_a_failure_between_commit_and_digests_adds_nothing_twice(spark, folder):
    registry = Registry(spark, str(folder / "registry"))

    class Fails(Ingest):
        def run(self, docs, batch=None):
            super().run(docs, batch)
            raise OSError("lost after the commit")

    ask = lambda kind: ingest_stream(stream_documents(spark, str(folder / "in")), kind(spark, registry), str(folder / "checkpoint"))
    with pytest.raises(Exception, match="lost after the commit"):
        ask(Fails).awaitTermination(120)
    assert state(registry)["relationships"] == 3
    ask(Ingest).awaitTermination(120)
    assert state(registry)["relationships"] == 3
    assert all_ok(health(spark, registry)).first()["ok"] is True


def test_of_two_writers_of_a_version_one_fails(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "r")).create()
    old = registry._version()
    registry.commit(batch="a")
    late = Registry(spark, str(tmp_path / "r"))
    late._version = lambda: old
    with pytest.raises(Conflict):
        late.commit(batch="b")
    assert registry.has_batch("a") and not registry.has_batch("b")


# one person under two names, as a model that knows them would say
ALIASES = {"Gaius Julius Caesar Augustus": "augustus", "Octavian": "augustus"}


class AliasEmbedder(HashingEmbedder):
    asked: list = []

    def embed(self, texts):
        names = [t.split(":")[0] for t in texts]
        return super().embed([ALIASES.get(n, n) for n in names])


def judge():
    def answers(rows):
        assert sum(len(r[c].split()) for r in rows for c in BatchVerifier.COLUMNS) + 5 <= 30 or len(rows) == 1
        same = [ALIASES.get(r["name"], r["name"]) == ALIASES.get(r["other_name"], r["other_name"]) for r in rows]
        return [{"are_same": True, "updated_name": "", "updated_description": "the first emperor of Rome"} if s else None for s in same]

    return answers


def test_augustus_and_octavian_are_one_and_found_again(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "r"))
    verifier = BatchVerifier(judge, budget=30, reserve=5, limiter=lambda: SlidingWindow(1000, 1_000_000))
    ingest = Ingest(spark, registry, Settings(threshold=0.8), AliasEmbedder, verifier, limiter=lambda: SlidingWindow(1000, 1_000_000))

    def resolve(names):
        objects = spark.createDataFrame([(n, n, f"about {n}") for n in names], "hash string, name string, description string")
        ingest.added, ingest.changed, ingest.objects = {}, {}, {}
        got = {r["hash"]: r["reference"] for r in ingest.resolve(objects, "entities").collect()}
        registry.commit(ingest.added, ingest.changed)
        return got

    first = resolve(["Gaius Julius Caesar Augustus", "Roman Empire", "Octavian"])
    assert first["Gaius Julius Caesar Augustus"] == first["Octavian"] != first["Roman Empire"]
    before = {r["id"]: list(r["embedding"]) for r in registry.table("entities").collect()}
    assert len(before) == 2
    again = resolve(["Octavian"])
    assert again == {"Octavian": first["Octavian"]}
    after = {r["id"]: r for r in registry.table("entities").collect()}
    assert len(after) == 2 and list(after[first["Roman Empire"]]["embedding"]) == before[first["Roman Empire"]]


def test_vectors_that_are_there_stay_and_requests_keep_their_size(spark):
    class Counts(Embedder):
        max_batch_size, max_batch_tokens, max_tokens, dimensions, prefixes = 3, 5, 2, 1, {"document": "d "}

        def embed(self, texts):
            assert len(texts) <= 3 and all(t.startswith("d ") for t in texts) and (len(texts) == 1 or sum(len(t.split()) for t in texts) <= 5)
            return [[float(len(t.split()))] for t in texts]

    rows = spark.createDataFrame([(1, "a b c", None), (2, "a", [9.0]), (3, " \n", []), (4, None, None), (5, "x", [])], "id int, text string, embedding array<float>").coalesce(1)
    got = {r["id"]: list(r["embedding"] or []) for r in embed_column(rows, "text", Counts).collect()}
    assert got == {1: [3.0], 2: [9.0], 3: [], 4: [], 5: [2.0]}
    assert list(request_batches(["a b", "c", "d e f g h i", "j"], 9, 3, lambda t: len(t.split()))) == [(0, 2, 3), (2, 3, 6), (3, 4, 1)]


def test_prompts_and_scratch(spark, tmp_path):
    made = PromptExtractor(lambda prompt: json.dumps([{"n": len(prompt.split())}]), SlidingWindow(9, 10_000))
    assert made.extract(["a b"])[0][0]["n"] > 10
    with staging.scratch(spark):
        gone = staging.materialize(spark.range(3), "x")
        kept = staging.materialize(spark.range(4), "y", keep=True)
    assert kept.count() == 4
    with pytest.raises(Exception):
        spark.read.parquet(gone.inputFiles()[0]).count()
    parsed = spark.createDataFrame([("[]",)], "answer string").select(triples.parse(F.col("answer")).alias("t")).first()
    assert parsed["t"] == []
