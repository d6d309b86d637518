"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import pytest

from skyledger import registry

DATA = "/root/testdata/sf0.001"
NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def told(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return repr(value)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    mine = registry.queries()[name](spark, DATA).toArrow()
    theirs = duck.execute(registry.oracle_sql()[name]).to_arrow_table()
    columns = sorted(mine.column_names)
    assert columns == sorted(theirs.column_names)
    rows = [sorted(tuple(told(r[c]) for c in columns) for r in t.to_pylist()) for t in (mine, theirs)]
    assert rows[0] == rows[1]


def test_entry_and_names():
    import __spark_entry__ as entry

    assert registry.FLAGSHIP in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
