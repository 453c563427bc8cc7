"""Every query with SQL against DuckDB over the smallest tables."""

import collections
import datetime
import decimal
import os

import duckdb
import pytest

from corpusgraph import queries as Q
from corpusgraph.inputs import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, db, name):
    df = Q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = db.execute(Q.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = collections.Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(Q.queries().keys() - Q.oracle_sql().keys()))
def test_runs(spark, name):
    assert Q.queries()[name](spark, SF).count() > 0
