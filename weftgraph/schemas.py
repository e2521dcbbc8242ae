"""Schemas of the tables that dataflows pass on."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()

DOCUMENT = T.StructType([T.StructField("uri", _S), T.StructField("content", _S), T.StructField("file_type", _S)])

#: What an extractor returns for a chunk; the constraint and the source may be missing.
TRIPLE_FIELDS = ["from_entity", "from_entity_description", "to_entity", "to_entity_description", "relationship_type", "relationship_description", "constraint_condition", "reason", "is_causal", "source_document_uri"]
TRIPLE = T.StructType([T.StructField(f, _B if f == "is_causal" else _S, f in ("constraint_condition", "source_document_uri")) for f in TRIPLE_FIELDS])
#: Columns of a triple as dataflows carry it on, in order.
TRIPLE_COLUMNS = ["from_entity", "relationship_type", "to_entity", "constraint_condition", "reason", "is_causal", "from_entity_description", "to_entity_description", "relationship_description", "source_document_uri"]
#: Fields of which an empty one spoils the whole answer for a chunk.
REQUIRED = ["from_entity", "to_entity", "relationship_type", "reason"]
HASHES = ["from_entity_hash", "to_entity_hash", "relationship_type_hash"]
REFERENCES = ["from_entity_reference", "to_entity_reference", "relationship_type_reference"]

CHUNK = T.ArrayType(T.StructType([T.StructField("chunk_no", _I), T.StructField("text", _S), T.StructField("start_char", _I), T.StructField("end_char", _I), T.StructField("is_paragraph_boundary", _B), T.StructField("is_sentence_boundary", _B)]))

OBJECTS = T.StructType([T.StructField("id", _L), T.StructField("name", _S), T.StructField("description", _S), T.StructField("embedding", T.ArrayType(T.FloatType()))])
RELATIONSHIPS = T.StructType([T.StructField("id", _L), T.StructField("from_entity", _L), T.StructField("relationship_type", _L), T.StructField("to_entity", _L), T.StructField("constraint_condition", _S), T.StructField("reason", _S), T.StructField("is_causal", _B), T.StructField("source_document_uri", _S)])
NODES = T.StructType([T.StructField("pg_id", _L), T.StructField("name", _S)])
EDGES = T.StructType([T.StructField("src", _L), T.StructField("dst", _L), T.StructField("rel_type", _S), T.StructField("pg_id", _L)])

#: Models' answers by the digest of what they were asked: JSON of an extractor, or a vector.
ANSWERS = T.StructType([T.StructField("model", _S), T.StructField("digest", _S), T.StructField("answer", _S), T.StructField("vector", T.ArrayType(T.FloatType()))])

#: What a model's calls of a run cost, a row for each commit of answers.
CALLS = T.StructType([T.StructField("run", _S), T.StructField("model", _S), T.StructField("requests", _L), T.StructField("texts", _L), T.StructField("tokens", _L), T.StructField("seconds", T.DoubleType()), T.StructField("refusals", _L), T.StructField("errors", _L)])
