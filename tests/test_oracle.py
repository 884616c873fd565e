"""Every query with SQL gives on the smallest tables what DuckDB gives."""

import importlib
import math
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")

CORE = [n for m in entry._MODULES for n in importlib.import_module(m).QUERIES]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    if isinstance(v, (int, bool)):
        return repr(float(v))
    return "null" if v is None else str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", CORE)
def test_same_as_sql(spark, con, name):
    df = entry.queries()[name](spark, str(DATA))
    rows = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, rows) == _rows(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
