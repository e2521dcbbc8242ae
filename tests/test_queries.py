"""Every core query against its SQL, on the smallest tables."""

import os
import pathlib

import duckdb
import pandas as pd
import pytest

from weftgraph import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(df):
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        return repr(float(v)) if isinstance(v, float) else str(v)

    columns = sorted(df.columns)
    # a column with nulls may come as floats on one side
    whole = {c: df[c].dropna().map(lambda v: not isinstance(v, float) or v == int(v)).all() for c in columns}
    return columns, sorted(tuple(text(int(v) if whole[c] and isinstance(v, float) and v == v else v) for c, v in zip(columns, row, strict=True)) for row in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, duck, name):
    got, wanted = queries.Q[name](spark, SF).toPandas(), duck.execute(queries.SQL[name]).df()
    assert normal(got) == normal(wanted)


@pytest.mark.parametrize("name", sorted(set(queries.Q) - set(queries.SQL)))
def test_query_runs(spark, name):
    assert queries.Q[name](spark, SF).count() > 0


def test_both_kinds_of_candidates(spark):
    kinds = queries.Q["candidate_union"](spark, SF).groupBy("is_from_input_list").count().collect()
    assert {r["is_from_input_list"] for r in kinds} == {True, False} and all(r["count"] > 1 for r in kinds)


def test_source_listing(spark):
    wanted = sorted((p.name, p.stat().st_size) for p in pathlib.Path(SF).rglob("*") if p.is_file() and p.name[0] not in "._")
    assert sorted(tuple(r) for r in queries.Q["source_listing"](spark, SF).collect()) == wanted


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
