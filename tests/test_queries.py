"""Every query with SQL gives the SQL's rows."""

import datetime
import math

import duckdb
import pytest

from orbitloom import catalog

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in got.collect()), key=key)
    order = [columns.index(c) for c in sorted(columns)]
    b = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=key)
    assert len(a) == len(b) and len(a) > 0
    assert a == b
