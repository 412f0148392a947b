"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from gridloom.plans.oracles import ORACLES
from gridloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def near(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name[:-8]} as select * from '{SF}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(near(r[n]) for n in names) for r in df.collect()), key=repr)
    want = db.sql(ORACLES[name])
    at = [want.columns.index(n) for n in names]
    assert got == sorted((tuple(near(r[k]) for k in at) for r in want.fetchall()), key=repr)
    assert got and len(want.columns) == len(names)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
