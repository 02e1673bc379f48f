"""Registered queries against their SQL twins at the smallest scale."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from threatlake.catalog.oracles import ORACLES
from threatlake.catalog.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return v.isoformat() if isinstance(v, pd.Timestamp) else str(float(v)) if isinstance(v, float) else str(v)


def shape(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


def test_names():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert ORACLES.items() <= entry.oracle_sql().items() and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, sf, duck, name):
    got, want = shape(entry.queries()[name](spark, sf).toPandas()), shape(duck.execute(ORACLES[name]).df())
    assert got == want


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 15 and "risk_score" in df.columns
