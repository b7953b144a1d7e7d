"""Every core query runs on the smallest tables and agrees with its DuckDB statement."""

import glob
import math
import os

import duckdb
import pytest

from textmill.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 5) + 0.0)
    return repr(value)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        return
    result = duck.execute(sql)
    names = [c[0] for c in result.description]
    want = result.fetchall()
    assert sorted(names) == sorted(df.columns)
    pick = [names.index(c) for c in df.columns]
    assert sorted(tuple(map(_plain, r)) for r in got) == sorted(tuple(_plain(r[i]) for i in pick) for r in want)
