"""Every registered engine query with SQL, against DuckDB, on the small tables."""

import datetime
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from millrace.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def cell(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, (float, np.floating)) and x != x):
        return ""
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.number)):
        return f"{float(x):.6f}"
    return str(pd.Timestamp(x)) if isinstance(x, (datetime.date, pd.Timestamp, np.datetime64)) else str(x)


def table(df):
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted(tuple(cell(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    assert table(QUERIES[name](spark, DATA).toPandas()) == table(db.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
