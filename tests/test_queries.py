"""Every query with SQL gives the rows that DuckDB gives."""

import decimal
import glob
import os

import duckdb
import pytest

from lodeweave.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(row):
    return tuple(round(float(x), 6) if isinstance(x, float | decimal.Decimal) else x for x in row)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    mine = sorted((normal(r[c] for c in names) for r in df.collect()), key=repr)
    found = duck.execute(ORACLE_SQL[name])
    theirs = [c[0] for c in found.description]
    assert sorted(theirs) == names
    rows = sorted((normal(r[theirs.index(c)] for c in names) for r in found.fetchall()), key=repr)
    assert mine == rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
