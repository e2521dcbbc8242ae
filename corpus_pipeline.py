"""From raw documents to token counts, in five stages; each takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import byte_bpe, jaccard_join, mixing, passages, quality, substring_dedup
from weftgraph.llm.common import load, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
RANKS = "byte_bpe_multi_50k.tiktoken"


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, load(spark, sf_dir, "labels")).select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each group linked by a Jaccard similarity of 0.8 over shingles of five words."""
    return jaccard_join.keep_one(docs, shingle=5, percent=80).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines, sentences and passages of 50 words that an earlier document, or an earlier place, has; documents left without any text go."""
    units = substring_dedup.dedup_units(docs).withColumn("__had", F.col("text").rlike(r"\S")).filter(F.col("__had") | (F.col("n_removed") == 0) | F.col("__had").isNull())
    done = passages.drop_passages(materialize(units.select(*COLUMNS, "__had"), "units-left"))
    return done.filter(F.col("text").rlike(r"\S") | ~F.coalesce("__had", F.lit(False))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target rate and their id say, dealt out anew."""
    return mixing.mix_sources(docs).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, the number of these, and whether they decode to the text."""
    return byte_bpe.round_trip_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN).select(*COLUMNS, "token_ids", "n_tokens", "round_trip")


STAGES = [("quality_classifier", classify), ("jaccard_join", deduplicate), ("substring_dedup", drop_repeats), ("source_mixing", mix), ("byte_bpe", tokenize)]

#: Neither the model's perplexities nor the tokens can be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
