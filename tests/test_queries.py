"""Every query runs over the smallest tables and equals its SQL there."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from factloom.plans import oracle, queries


@pytest.fixture(scope="module")
def other():
    c = duckdb.connect()
    for p in glob.glob("/root/testdata/sf0.001/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted((tuple(None if pd.isna(x) else round(float(x), 6) if not isinstance(x, str) else x for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, other, data, name):
    got = queries.QUERIES[name](spark, data).toPandas()
    if name in oracle.ORACLE:
        assert rows(got) == rows(other.sql(oracle.ORACLE[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
