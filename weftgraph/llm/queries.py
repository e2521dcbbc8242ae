"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import byte_bpe, clustering, conversations, fingerprints, jaccard_join, licenses, mixing, neighbours, quality, sharding, simhash, substring_dedup, toxicity
from weftgraph.llm.common import load

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = toxicity.score_toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return done.withColumn("evidence", F.to_json("evidence"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(load(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest_documents(load(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(load(spark, sf_dir, "documents"), shingle=4, percent=85)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return done.drop("print")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(load(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 9))


def op7_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sharding.shard_documents(load(spark, sf_dir, "documents"))
    return done.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(load(spark, sf_dir, "documents")).withColumn("licenses", F.array_join("licenses", ",")).withColumn("matches", F.to_json("matches"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.dedup_units(load(spark, sf_dir, "documents"))
    spans = F.transform("removed_spans", lambda s: F.concat_ws("-", s["start"], s["end"]))
    return done.withColumn("removed_spans", F.array_join(spans, ","))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(load(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_digests(load(spark, sf_dir, "conversations"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(load(spark, sf_dir, "embeddings")).drop("worked")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_document_fingerprints, op3_byte_bpe, op4_jaccard_join, op5_quality_classifier, op6_source_mixing, op7_histogram_sharding, op8_nearest_neighbours, op9_license_scan, op10_substring_dedup, op11_simhash_near_dedup, op12_conversation_repair, op13_centroid_clustering)}
ORACLES = {"op6_source_mixing": mixing.ORACLE_SQL, "op10_substring_dedup": substring_dedup.ORACLE_SQL, "op13_centroid_clustering": clustering.ORACLE_SQL}
