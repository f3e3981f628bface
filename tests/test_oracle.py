"""Every registered query against its DuckDB SQL oracle on the smallest tables."""

import os
import sys

import duckdb
import pytest

from conftest import SF_SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from oracle_check import TABLES, rows_of  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from shiftlake.plans.catalog import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() > 0 and "cancellation_rate" in df.columns


def test_every_query_has_sql_except_rows_only():
    missing = set(QUERIES) - set(oracle_sql())  # the optional subpackage has its own tests
    assert missing == set()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF_SMALL)
    sc, sr = rows_of(df.columns, df.collect())
    res = con.execute(oracle_sql()[name])
    dc, dr = rows_of([d[0] for d in res.description], res.fetchall())
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr
