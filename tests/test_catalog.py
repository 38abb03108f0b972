"""The registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from sleuthframe.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()
#: The checks are held against their samples elsewhere; a few stand for the way through the tables.
KEYS = [k for k in catalog.QUERIES if not k.startswith("check_")] + ["check_dead_code", "check_stdlib_alternatives", "check_bug_magnet"]


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    return round(v, 6) if isinstance(v, float) else str(v) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_query(spark, con, key):
    got = catalog.QUERIES[key](spark, SF).toPandas()
    want = con.execute(catalog.SQL[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(str(tuple(plain(v) for v in r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_each_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
