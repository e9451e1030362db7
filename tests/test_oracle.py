"""Every registered query against its SQL twin on the smallest scale factor."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from lakeops.plans import catalog

ROOT = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalog.QUERIES, catalog.ORACLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in sorted(os.listdir(ROOT)):
        if f.endswith(".parquet"):
            c.sql(f"create view {f[:-8]} as select * from '{ROOT}/{f}'")
    return c


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return int(v) if v.is_integer() else float(f"{v:.12g}")
    return v


def canon(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(map(cell, r)) for r in pdf.itertuples(index=False, name=None)),
                  key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    got, want = QUERIES[name](spark, ROOT).toPandas(), con.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert QUERIES.keys() <= entry.queries().keys() and ORACLE.keys() <= entry.oracle_sql().keys()
    assert entry.entry(spark).count() > 0
