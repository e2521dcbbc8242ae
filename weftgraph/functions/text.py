"""Column functions over strings and vectors; all but token counters of models are Spark's own, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def identity_hash(name: Column, description: Column) -> Column:
    """MD5 of "name: description". Nulls are skipped, and the separator may occur in data: ("a: b", "c") and ("a", "b: c") are one."""
    return F.md5(F.concat_ws(": ", name, description))


def embed_text(name: Column, description: Column, prefix: str = "") -> Column:
    """"name: description", or the one of them that isn't empty, after a prefix."""
    n, d = F.coalesce(name, F.lit("")), F.coalesce(description, F.lit(""))
    text = F.when((n != "") & (d != ""), F.concat(n, F.lit(": "), d)).when(n != "", n).otherwise(d)
    return F.concat(F.lit(prefix), text)


def is_blank(text: Column) -> Column:
    """Whether a text is null or has nothing but white space, line breaks and tabs included."""
    return ~F.coalesce(text.rlike(r"\S"), F.lit(False))


def token_count(text: Column, count: Callable[[str], int] | None = None) -> Column:
    """White-space words; 0 for null. With `count`, a model's own counter (as chunk_documents takes it), called in Arrow batches."""
    if count is None:
        return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))

    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([0 if t is None else count(t) for t in texts], dtype="int32")

    return counted(text)


# The patterns at which texts are split, and what a type of edge may not hold.
PARAGRAPH_GAP, SENTENCE_GAP, NOT_IN_TYPE = r"\n\s*\n", r"(?<=[.!?])\s+", "[^a-zA-Z0-9_]"


def paragraphs(text: Column) -> Column:
    return F.split(text, PARAGRAPH_GAP)


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_GAP)


def words(text: Column) -> Column:
    """White-space words; none for blank texts."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def edge_type(name: Column) -> Column:
    """A relationship's name as the type of a graph's edges."""
    return F.upper(F.regexp_replace(name, NOT_IN_TYPE, "_"))


def label(name: Column, ident: Column) -> Column:
    return F.concat(name, F.lit(" ["), ident.cast("string"), F.lit("]"))


def title(status: Column) -> Column:
    return F.initcap(F.replace(status, F.lit("_"), F.lit(" ")))


def normal_constraint(constraint: Column, exact: bool = False) -> Column:
    """"None" in any case (exact: spelt so) and null as the empty string."""
    c = F.coalesce(constraint, F.lit(""))
    return F.when((c == "None") if exact else (F.lower(c) == "none"), F.lit("")).otherwise(c)


def yes(answer: Column) -> Column:
    return F.coalesce(F.lower(answer) == "yes", F.lit(False))


def norm(vector: Column) -> Column:
    """Euclidean norm, in doubles."""
    return F.sqrt(F.aggregate(vector.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def unit(vector: Column) -> Column:
    """The vector over its norm, of which 1e-10 is the least."""
    size = F.greatest(norm(vector), F.lit(1e-10))
    return F.transform(vector.cast("array<double>"), lambda x: x / size)


def file_type(path: Column) -> Column:
    """What follows the last dot of a path's last part, as it is spelt; empty without one."""
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def readable(path: Column) -> Column:
    return F.lower(file_type(path)).isin("txt", "md")


def uri_bucket(uri: Column) -> Column:
    """The bucket of an s3 address; null if it isn't one."""
    return F.nullif(F.regexp_extract(uri, "^s3://([^/]+)/?(.*)$", 1), F.lit(""))


def uri_prefix(uri: Column) -> Column:
    """The key of an s3 address, which may be empty; null if it isn't one."""
    return F.when(uri_bucket(uri).isNotNull(), F.regexp_extract(uri, "^s3://([^/]+)/?(.*)$", 2))
