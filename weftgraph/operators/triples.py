"""Triples: from an extractor's JSON to rows with identity hashes, and the entities and relationship types they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.text import identity_hash
from weftgraph.schemas import REQUIRED, TRIPLE, TRIPLE_COLUMNS

TRIPLES = T.ArrayType(TRIPLE)


def parse(answers: Column) -> Column:
    """Triples from an extractor's JSON; null if it is malformed."""
    return F.from_json(answers, TRIPLES)


def valid(triples: Column) -> Column:
    """The triples of an answer, none if any of them lacks a required field: an answer counts as a whole."""
    whole = F.forall(triples, lambda t: F.coalesce(F.least(*[F.length(t[f]) for f in REQUIRED]) > 0, F.lit(False)))
    return F.when(whole, triples).otherwise(F.array().cast(TRIPLES))


def explode(docs: DataFrame, triples_col: str = "triples", uri_col: str = "uri") -> DataFrame:
    """A row for each triple, of TRIPLE_COLUMNS; its source is the document's, whatever the extractor says. Documents without triples give no row."""
    rows = docs.select(F.col(uri_col).alias("__uri"), F.explode(triples_col).alias("t"))
    return rows.select(*[F.col("__uri").alias(c) if c == "source_document_uri" else F.col(f"t.{c}").alias(c) for c in TRIPLE_COLUMNS])


def with_hashes(triples: DataFrame) -> DataFrame:
    """triples with the identity hashes of both entities and of the relationship type."""
    sides = {"from_entity_hash": ("from_entity", "from_entity_description"), "to_entity_hash": ("to_entity", "to_entity_description"), "relationship_type_hash": ("relationship_type", "relationship_description")}
    return triples.withColumns({h: identity_hash(F.col(n), F.col(d)) for h, (n, d) in sides.items()})


def _distinct(objects: DataFrame) -> DataFrame:
    """One row for each hash. Where a hash stands for several names, the least name and description. Repeats go first, by hashing in each task: a minimum of strings is found by sorting, which would be of all rows."""
    # a plain distinct() would be left out by Spark, as a minimum doesn't need it; so the repeats are counted
    once = objects.groupBy("hash", "name", "description").agg(F.count(F.lit(1)).alias("__n"))
    least = lambda c: F.min(F.when(F.col("__n") > 0, F.col(c))).alias(c)
    return once.groupBy("hash").agg(least("name"), least("description"))


def entities(triples: DataFrame) -> DataFrame:
    """hash, name, description of the entities at either end."""
    ends = [F.struct(F.col(f"{e}_entity_hash").alias("hash"), F.col(f"{e}_entity").alias("name"), F.col(f"{e}_entity_description").alias("description")) for e in ("from", "to")]
    return _distinct(triples.select(F.inline(F.array(*ends))))


def relationship_types(triples: DataFrame) -> DataFrame:
    """hash, name, description of the relationship types."""
    return _distinct(triples.select(F.col("relationship_type_hash").alias("hash"), F.col("relationship_type").alias("name"), F.col("relationship_description").alias("description")))
