"""Driver contract: every registered query against its DuckDB oracle on sf0.001."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from basketlens.plans.oracles import ORACLES
from basketlens.plans.registry import QUERIES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
NO_ORACLE = {"als_users_for_items", "als_items_for_users", "als_rmse"}


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


def _norm(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(None if (isinstance(v, float) and math.isnan(v)) else v for v in row)
                  for row in df.itertuples(index=False))


def test_contract_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and set(QUERIES) <= set(q)
    assert set(QUERIES) - set(o) == NO_ORACLE


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["prodName", "earnings", "percentEarning"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, sf_small, name):
    got = E.queries()[name](spark, sf_small).toPandas()
    exp = duck.execute(E.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(exp.columns)
    assert len(got) == len(exp)
    assert _norm(got) == _norm(pd.DataFrame(exp))
