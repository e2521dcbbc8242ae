"""Documents in, registry, relationships and graph out."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.text import embed_text, identity_hash
from weftgraph.operators import linking, resolution, similarity, triples
from weftgraph.operators.chunking import chunk_documents
from weftgraph.operators.registry import Registry, assign_ids
from weftgraph.plans.answers import answered
from weftgraph.plans.models import EXTRACTION_PROMPT, Embedder, Extractor, HashingEmbedder, RuleVerifier, SlidingWindow, Verifier, embed_column, extract_triples, extractor_named
from weftgraph.plans.requests import SharedLimiter, factory_key
from weftgraph.plans.staging import materialize, scratch
from weftgraph.sources.documents import distinct_documents


@dataclass(frozen=True)
class Settings:
    """All that an ingest run can be told."""

    extractor: str = "pattern"
    chunk_tokens: int = 4_000
    threshold: float = similarity.THRESHOLD
    epsilon: float = similarity.EPSILON
    registry_candidates: int = similarity.CANDIDATES
    link_mode: str = "verified"
    permissive: bool = False
    #: To be changed with a model or its prompt: answers are kept by it.
    model_version: str = ""


class Ingest:
    """One dataflow over a batch of documents. Its steps are DataFrames; model answers are written before they are used, so they are asked for once."""

    def __init__(self, spark: SparkSession, registry: Registry, settings: Settings = Settings(), embedder: Callable[[], Embedder] = HashingEmbedder, verifier: Verifier | None = None, limiter: Callable[[], SlidingWindow | SharedLimiter] | None = None) -> None:
        self.spark, self.registry, self.settings, self.embedder = spark, registry.create(), settings, embedder
        self.verifier, self.limiter = verifier or RuleVerifier(), limiter
        self.extractor: Callable[[], Extractor] = extractor_named(settings.extractor)

    def extract(self, docs: DataFrame, run: str = "") -> DataFrame:
        """Triples with identity hashes, of documents (uri, content, file_type). Chunks are dealt out anew before the model is asked, as a long document's all come from one task."""
        chunks = chunk_documents(distinct_documents(docs), self.settings.chunk_tokens).select("uri", "chunk_no", "chunk")
        model = f"extract:{factory_key(self.extractor)}:{hashlib.sha256(EXTRACTION_PROMPT.encode()).hexdigest()}:{self.settings.model_version}"
        ask = lambda texts: extract_triples(texts.repartition("digest"), self.extractor, permissive=self.settings.permissive)
        answers = answered(chunks, "chunk", model, self.registry, ask, "answer", run=run).withColumn("answer", F.coalesce("answer", F.lit("[]")))
        parsed = answers.withColumn("triples", triples.valid(triples.parse(F.col("answer"))))
        return triples.with_hashes(triples.explode(parsed))

    def _embedded(self, rows: DataFrame) -> DataFrame:
        """rows (name, description, maybe embedding) with the vectors that they lack, asked for once for each text."""
        asked = rows.withColumn("text", embed_text(F.col("name"), F.col("description")))
        if "embedding" not in rows.columns:
            asked = asked.withColumn("embedding", F.lit(None).cast("array<float>"))
        have = F.coalesce(F.size("embedding") > 0, F.lit(False))
        model = f"embed:{factory_key(self.embedder)}:{self.settings.model_version}"
        ask = lambda texts: embed_column(texts.repartition("digest"), "text", self.embedder, "vector", limiter=self.limiter)
        found = answered(asked.withColumn("text", F.when(~have, F.col("text"))), "text", model, self.registry, ask, "vector")
        return found.withColumn("embedding", F.coalesce(F.when(have, F.col("embedding")), "vector", F.array().cast("array<float>"))).drop("text", "vector", "error")

    def resolve(self, objects: DataFrame, table: str) -> DataFrame:
        """hash, reference of objects (hash, name, description, maybe embedding); the registry's table gets what is new to it, and new vectors of rows whose text a verifier has changed."""
        s, stored = self.settings, self.registry.table(table)
        if "embedding" not in objects.columns:
            # an object that the registry has word for word has its vector there
            known = stored.groupBy(identity_hash(F.col("name"), F.col("description")).alias("hash")).agg(F.min_by("embedding", "id").alias("embedding"))
            objects = objects.join(known, "hash", "left")
        vectors = materialize(self._embedded(objects), "objects")
        near = similarity.candidates(vectors, self.registry.segments(table) or stored, s.threshold, s.epsilon, s.registry_candidates, ident="hash", ref="id")
        named = vectors.select(F.col("hash").alias("src"), "name", "description")
        others = vectors.select(F.col("hash").alias("dst"), F.col("name").alias("dst_name"), F.col("description").alias("dst_description"))
        rows = stored.select(F.col("id").alias("ref"), F.col("name").alias("ref_name"), F.col("description").alias("ref_description"))
        pairs = near.join(named, "src").join(others, "dst", "left").join(rows, "ref", "left")
        pairs = pairs.withColumns({"other_name": F.coalesce("dst_name", "ref_name"), "other_description": F.coalesce("dst_description", "ref_description")})
        verdicts = self.verifier.verify(pairs.select("src", "dst", "ref", "similarity", "name", "description", "other_name", "other_description"))
        verified = materialize(verdicts.withColumn("seq", F.struct((-F.col("similarity")).alias("s"), F.coalesce("dst", F.col("ref").cast("string")).alias("o"))), "verified")
        resolved, new = resolution.resolve(vectors.select("hash", "name", "description"), verified, stored, s.link_mode)
        resolved = materialize(resolved, "resolved")
        # one row for each new name: components that agree on it are one object; an object that keeps its text has its vector
        names = new.groupBy("name").agg(F.min_by("description", "component").alias("description"))
        texts = vectors.groupBy(identity_hash(F.col("name"), F.col("description")).alias("__text")).agg(F.first("embedding").alias("embedding"))
        fresh = materialize(assign_ids(names, self.registry.largest_id(table), ["name"]), "fresh")
        carried = fresh.withColumn("__text", identity_hash(F.col("name"), F.col("description"))).join(texts, "__text", "left").drop("__text")
        added = materialize(self._embedded(carried).select("id", "name", "description", "embedding"), "added")
        # a row whose text isn't what the registry has gets a new vector, the last by hash; the registry's own text stays
        told = resolved.filter(F.col("has_updates") & F.col("reference").isNotNull()).groupBy(F.col("reference").alias("id")).agg(F.max(F.struct("hash", "name", "description")).alias("t")).select("id", "t.name", "t.description")
        olds = stored.select("id", F.col("name").alias("__name"), F.col("description").alias("__description"), F.col("embedding").alias("__vector"))
        other = told.join(olds, "id").filter(~(F.col("name").eqNullSafe(F.col("__name")) & F.col("description").eqNullSafe(F.col("__description"))))
        changes = materialize(self._embedded(other), "changes").filter(~F.col("embedding").eqNullSafe(F.col("__vector")))
        self.added[table], self.changed[table] = added, changes.select("id", F.col("__name").alias("name"), F.col("__description").alias("description"), "embedding")
        self.objects[table] = stored.select("id", "name").unionByName(added.select("id", "name"))
        ids = new.select("component", "name").join(fresh.select("name", F.col("id").alias("new_id")), "name").select("component", "new_id")
        return materialize(resolved.join(ids, "component", "left").select("hash", F.coalesce("reference", "new_id").alias("reference")), "references")

    def run(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """The linked triples of docs; all tables of the registry change in one commit, under the name of the batch."""
        with scratch(self.spark):
            return self.store(materialize(self.extract(docs, batch or uuid.uuid4().hex), "triples"), batch)

    def store(self, found: DataFrame, batch: str | None = None) -> DataFrame:
        """Resolves, links and stores triples that have their hashes."""
        self.added, self.changed, self.objects = {}, {}, {}
        # both kinds at once: each a chain of jobs of its own, which leave room beside each other
        with ThreadPoolExecutor(2) as pool:
            kinds = [pool.submit(self.resolve, objects, table) for objects, table in ((triples.entities(found), "entities"), (triples.relationship_types(found), "relationship_types"))]
            entity_refs, type_refs = (k.result() for k in kinds)
        linked = materialize(linking.link_references(found, entity_refs, type_refs), "linked", keep=True)
        rows = linking.relationships(linked)
        added = materialize(assign_ids(rows, self.registry.largest_id("relationships"), rows.columns), "relationships")
        old = self.registry.table("nodes")
        nodes = materialize(linking.graph_nodes(linked, old), "nodes")
        edges = linking.graph_edges(added, self.objects["relationship_types"], old.unionByName(nodes))
        self.registry.commit({**self.added, "relationships": added, "nodes": nodes, "edges": edges}, self.changed, batch=batch)
        return linked


def health(spark: SparkSession, registry: Registry) -> DataFrame:
    """service, state, message: whether Spark answers and the registry's tables can be read."""
    rows = [("spark", "OK" if spark.range(1).count() == 1 else "ERROR", spark.version)]
    try:
        registry.create().table("entities").limit(1).count()
        rows.append(("registry", "OK", registry.path))
    except Exception as failed:  # the state is what is asked for
        rows.append(("registry", "ERROR", str(failed)[:200]))
    return spark.createDataFrame(rows, "service string, state string, message string")


def all_ok(states: DataFrame) -> DataFrame:
    """One row, ok: whether every state is "OK"; true without any."""
    return states.agg(F.coalesce(F.bool_and(F.col("state") == "OK"), F.lit(True)).alias("ok"))
