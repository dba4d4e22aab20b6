"""Every registered query against its SQL counterpart."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from workload.inputs import TABLES

QUERIES, ORACLES = entry.QUERIES, entry.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def normal(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(([plain(v) for v in r] for r in pdf.itertuples(index=False)), key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, duck):
    got = QUERIES[name](spark, SMALL).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
    assert len(got) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
