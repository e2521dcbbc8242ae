"""Documents from a folder or bucket, as (uri, content, file_type)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text as fn


def parse_uri(uri: str) -> tuple[str, str]:
    """Bucket and key prefix of an s3 address; ValueError if it isn't one."""
    found = re.fullmatch(r"s3://([^/]+)/?(.*)", uri)
    if not found:
        raise ValueError(f"not an s3 address: {uri}")
    return found[1], found[2]


def list_files(spark: SparkSession, prefix: str, recursive: bool = True) -> DataFrame:
    """path and length of the files whose path begins with a prefix; contents aren't read. The prefix is raw: "a/foo" also finds "a/foobar/x"."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(prefix if prefix.endswith("/") else f"{prefix}*").select("path", "length")


def to_documents(files: DataFrame) -> DataFrame:
    """Of binaryFile rows those that are .txt or .md (in any case) and valid UTF-8, decoded; others are left out."""
    kept = files.filter(fn.readable(F.col("path")) & F.is_valid_utf8(F.col("content").cast("string")))
    return kept.select(F.col("path").alias("uri"), F.decode("content", "UTF-8").alias("content"), fn.file_type(F.col("path")).alias("file_type"))


def read_documents(spark: SparkSession, prefix: str) -> DataFrame:
    """The documents below a prefix. Spark reads the files in parallel; corrupt ones are skipped."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
    return to_documents(reader.load(prefix if prefix.endswith("/") else f"{prefix}*"))


def distinct_documents(docs: DataFrame, key: str = "content", ident: str = "uri") -> DataFrame:
    """One row for each content, that of the smallest ident. Contents are grouped by digest, so each is moved once at most."""
    first = docs.groupBy(F.sha2(F.col(key), 256).alias("__digest")).agg(F.min(F.struct(F.col(ident).alias("__ident"), *[F.col(c) for c in docs.columns])).alias("__row"))
    return first.select(*[F.col(f"__row.{c}").alias(c) for c in docs.columns])
