import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text as fn
from weftgraph.sources.documents import parse_uri


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_identity_hash_skips_nulls_and_collides_at_the_separator(spark):
    h = lambda a, b: one(spark, fn.identity_hash(F.lit(a).cast("string"), F.lit(b).cast("string")))
    assert h("a: b", "c") == h("a", "b: c")
    assert h("a", None) == one(spark, F.md5(F.lit("a")))


@pytest.mark.parametrize("name, description, expected", [("a", "b", "p a: b"), ("a", "", "p a"), (None, "b", "p b"), ("", None, "p ")])
def test_embed_text(spark, name, description, expected):
    assert one(spark, fn.embed_text(F.lit(name).cast("string"), F.lit(description).cast("string"), "p ")) == expected


def test_constraints_and_answers(spark):
    assert one(spark, fn.normal_constraint(F.lit("NONE"))) == ""
    assert one(spark, fn.normal_constraint(F.lit("NONE"), exact=True)) == "NONE"
    assert one(spark, fn.normal_constraint(F.lit(None).cast("string"))) == ""
    assert one(spark, fn.yes(F.lit("YES"))) is True
    assert one(spark, fn.yes(F.lit(None).cast("string"))) is False


def test_edge_types_labels_titles(spark):
    assert one(spark, fn.edge_type(F.lit("is-part of 2"))) == "IS_PART_OF_2"
    assert one(spark, fn.label(F.lit("Rome"), F.lit(3))) == "Rome [3]"
    assert one(spark, fn.title(F.lit("graph_store"))) == "Graph Store"


def test_vectors(spark):
    assert one(spark, fn.norm(F.array(F.lit(3.0), F.lit(4.0)))) == 5.0
    assert one(spark, fn.unit(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


def test_file_types(spark):
    assert one(spark, fn.file_type(F.lit("s3://b/a.b/c.MD"))) == "MD"
    assert one(spark, fn.file_type(F.lit("s3://b/a.b/c"))) == ""
    assert one(spark, fn.readable(F.lit("x.Txt"))) and not one(spark, fn.readable(F.lit("x.pdf")))


def test_uris(spark):
    assert parse_uri("s3://bucket/a/b") == ("bucket", "a/b")
    assert parse_uri("s3://bucket") == ("bucket", "")
    for bad in ("http://x", "s3://", "s3:///x"):
        with pytest.raises(ValueError):
            parse_uri(bad)
        assert one(spark, fn.uri_bucket(F.lit(bad))) is None
