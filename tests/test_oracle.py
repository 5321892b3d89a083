"""Every query with SQL against DuckDB on the same small tables, and every other one for a result."""

import datetime
import decimal
import os

import duckdb
import pytest

from bidlake import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def opened(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck(sf_dir):
    return opened(sf_dir)


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in table), key=lambda r: tuple((x is None, str(x)) for x in r))


#: Queries whose thresholds no row of the smallest tables reaches run on larger ones.
LARGER = {"stream_rate_limit": "sf0.01", "stream_first_event_limit": "sf0.01"}


@pytest.mark.parametrize("name", list(plans.queries()))
def test_query(spark, sf_dir, duck, name):
    if name in LARGER:
        sf_dir = os.path.join(os.path.dirname(sf_dir), LARGER[name])
        duck = opened(sf_dir)
    df = plans.queries()[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got, "a result without rows proves nothing"
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, result.fetchall())
