"""Every registered query of the library against its SQL in DuckDB, at the smallest size, as the driver compares them."""

import datetime
import glob
import os

import duckdb
import pytest

from quarry.plans import analytics, platform, search, web  # noqa: F401
from quarry.plans.registry import ORACLE_SQL, QUERIES

ROWS_ONLY = sorted(set(QUERIES) - set(ORACLE_SQL))


@pytest.fixture(scope="session")
def duck(sf):
    made = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        made.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return made


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return repr(x)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    return repr(round(float(x), 5) + 0.0)


def rows_in_order(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf, name):
    got = QUERIES[name](spark, sf)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    mine, theirs = rows_in_order(got.columns, got.collect()), rows_in_order(want.columns, want.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_has_rows(spark, sf, name):
    got = QUERIES[name](spark, sf)
    assert len(set(got.columns)) == len(got.columns)
    assert got.count() > 0
