"""Every query with SQL gives the rows that DuckDB gives for it, at the smallest scale."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(k for k in entry.oracle_sql() if not k.startswith("op") or not k[2].isdigit())


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, float):
        return f"{v:.9g}"
    return pd.Timestamp(v).isoformat() if hasattr(v, "isoformat") else str(v)


def table_of(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sf, duck, name):
    mine = entry.queries()[name](spark, sf).toPandas()
    theirs = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert table_of(mine) == table_of(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() == 4


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
