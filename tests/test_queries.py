"""Each registered query with SQL gives the SQL's rows."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from folioflow.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"/root/testdata/sf0.001/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    duck.execute(ORACLES[name])
    rows = duck.fetchall()
    names = [d[0] for d in duck.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(norm(r[names.index(c)]) for c in columns)) for r in rows)
