"""Every registered query with SQL gives DuckDB's rows on the smallest test data; the others run."""

import os

import duckdb
import pandas as pd
import pytest

from fumikura import queries as core

QS, SQL = core.queries(), core.oracle_sql()
SLOW = {"topic_communities", "topic_graph", "group_cv", "drift_table", "w2v_neighbours", "work_vectors"}


def _cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool) or not isinstance(v, (int, float)) and getattr(getattr(v, "dtype", None), "kind", "") not in ("i", "u", "f"):
        return str(v)
    return repr(round(float(v), 9) + 0.0)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(_cell, r)) for r in df.itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(set(QS) - SLOW))
def test_query(name, spark, data, duck):
    got = QS[name](spark, data).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_sql_has_queries():
    assert set(SQL) <= set(QS)
