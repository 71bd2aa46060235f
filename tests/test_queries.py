"""Every registered query of the library against its SQL on the same tables."""

import duckdb
import pytest

from furrow.plans import catalog
from furrow.plans.views import TABLES

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def engine(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, engine, small, name):
    df = catalog.queries()[name](spark, small)
    names = sorted(df.columns)
    mine = sorted(repr(tuple(r)) for r in df.select(*names).collect())
    if name not in SQL:
        assert mine
        return
    got = engine.execute(SQL[name])
    theirs = [d[0] for d in got.description]
    order = sorted(range(len(theirs)), key=theirs.__getitem__)
    assert sorted(theirs) == names
    assert sorted(repr(tuple(r[i] for i in order)) for r in got.fetchall()) == mine
