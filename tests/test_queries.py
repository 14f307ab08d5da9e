"""Every analytics query against its SQL in DuckDB, and the driver contract."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from corpuslens.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def norm(value):
    if isinstance(value, float):
        return round(value, 5)
    return tuple(map(norm, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows, cols = df.collect(), sorted(df.columns)
    if name not in SQL:
        assert cols
        return
    found = duck.sql(SQL[name])
    names = found.columns
    assert sorted(names) == cols
    ours = sorted((tuple(norm(r[c]) for c in cols) for r in rows), key=repr)
    theirs = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
