"""Every registered field query equals its SQL twin in DuckDB on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from fieldscope.plans import queries as field
from fieldscope.sources.tables import STORED

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in STORED:
        con.execute(f"create view {name} as select * from read_parquet('{FOLDER}/{name}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v + 0.0:.6f}"
    if isinstance(v, decimal.Decimal):
        return str(v)
    return None if v is None else str(v)


def test_every_query_has_a_twin():
    assert set(field.QUERIES) == set(field.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(field.QUERIES))
def test_query(spark, duck, name):
    df = field.QUERIES[name](spark, FOLDER)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    found = duck.execute(field.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    at = sorted(range(len(columns)), key=columns.__getitem__)
    assert sorted(df.columns) == sorted(columns)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)
