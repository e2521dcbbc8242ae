"""References of the registry on triples, and the relationships and graph made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import edge_type, label
from weftgraph.schemas import REFERENCES


def with_reference(rows: DataFrame, refs: DataFrame, side: str) -> DataFrame:
    """rows with the reference of one side (from_entity, to_entity, relationship_type) by its hash, null where refs (hash, reference) has none."""
    mapped = refs.filter(F.coalesce("reference", F.lit(0)) != 0).select(F.col("hash").alias(f"{side}_hash"), F.col("reference").alias(f"{side}_reference"))
    return rows.join(mapped, f"{side}_hash", "left")


def link_references(triples: DataFrame, entity_refs: DataFrame, type_refs: DataFrame) -> DataFrame:
    """triples with the three references, null where a hash has none. Refs have hash and reference. Spark broadcasts them while they are below its threshold, and joins by hash beyond. A side that has its reference already, as it was
    looked up for the table that the triples were made of (with_reference), is left as it is."""
    out = triples
    for refs, side in ((type_refs, "relationship_type"), (entity_refs, "from_entity"), (entity_refs, "to_entity")):
        if f"{side}_reference" not in triples.columns:
            out = with_reference(out, refs, side)
    return out.select(*[c for c in triples.columns if c not in REFERENCES], *REFERENCES)


def complete(linked: DataFrame) -> DataFrame:
    """Triples with all three references."""
    found = F.lit(True)
    for c in REFERENCES:
        found = found & F.col(c).isNotNull()
    return linked.filter(found)


def incomplete(linked: DataFrame) -> DataFrame:
    """Triples that lack a reference, null or 0."""
    lacking = F.lit(False)
    for c in REFERENCES:
        lacking = lacking | (F.coalesce(c, F.lit(0)) == 0)
    return linked.filter(lacking)


def relationships(linked: DataFrame) -> DataFrame:
    """Rows of the relationships table, but for their ids: one for each complete triple, repeats included."""
    return complete(linked).select(F.col("from_entity_reference").alias("from_entity"), F.col("relationship_type_reference").alias("relationship_type"), F.col("to_entity_reference").alias("to_entity"), "constraint_condition", "reason", "is_causal", "source_document_uri")


def graph_nodes(linked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pg_id, name) at either end of complete triples, that nodes lacks."""
    done = complete(linked)
    both = [F.struct(F.col(f"{e}_entity_reference").alias("pg_id"), F.col(f"{e}_entity").alias("name")) for e in ("from", "to")]
    return done.select(F.inline(F.array(*both))).distinct().join(nodes.select("pg_id", "name"), ["pg_id", "name"], "left_anti")


def graph_edges(relationships: DataFrame, types: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, rel_type, pg_id: an edge for each relationship and each pair of nodes with its ends' ids (several nodes may share an id under different names)."""
    named = relationships.join(types.select(F.col("id").alias("relationship_type"), edge_type(F.col("name")).alias("rel_type")), "relationship_type")
    starts, ends = nodes.select(F.col("pg_id").alias("from_entity")), nodes.select(F.col("pg_id").alias("to_entity"))
    return named.join(starts, "from_entity").join(ends, "to_entity").select(F.col("from_entity").alias("src"), F.col("to_entity").alias("dst"), "rel_type", F.col("id").alias("pg_id"))


def read_back(relationships: DataFrame, entities: DataFrame, types: DataFrame) -> DataFrame:
    """Relationships with "name [id]" for their ends and type."""

    def names(table: DataFrame, column: str) -> DataFrame:
        return table.select(F.col("id").alias(column), label(F.col("name"), F.col("id")).alias(f"{column}_label"))

    joined = relationships.join(names(entities, "from_entity"), "from_entity").join(names(entities, "to_entity"), "to_entity").join(names(types, "relationship_type"), "relationship_type")
    return joined.select("id", F.col("from_entity_label").alias("from_entity"), F.col("relationship_type_label").alias("relationship_type"), F.col("to_entity_label").alias("to_entity"), "constraint_condition", "reason", "is_causal", "source_document_uri")


def counts(linked: DataFrame) -> DataFrame:
    """One row, from one pass: triples, complete ones, and distinct source documents."""
    full = F.lit(True)
    for c in REFERENCES:
        full = full & F.col(c).isNotNull()
    return linked.agg(F.count(F.lit(1)).alias("n_triples"), F.count_if(full).alias("n_complete"), F.countDistinct("source_document_uri").alias("n_documents"))
