"""Every registered query against its DuckDB oracle on the smallest scale,
plus the driver's smoke check of entry()."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from gradewell.session import TABLES
from tools.check_oracle import rows_of

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "pass1_plan" in df.columns


def test_every_query_has_an_oracle():
    from gradewell.plans.queries import REGISTRY

    assert set(REGISTRY) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    s = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    d = res.fetchall()
    dcols = [x[0] for x in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, s) == rows_of(dcols, d)
