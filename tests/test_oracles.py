"""Every query that SQL can express, against DuckDB on the same tables."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from texmill import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, list | tuple):
        return [plain(x) for x in value]
    if isinstance(value, decimal.Decimal):
        value = float(value)
    return round(value, 9) if isinstance(value, float) else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(repr(plain(r[i])) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(name, spark, duck):
    df = registry.QUERIES[name](spark, SF)
    cur = duck.execute(registry.ORACLES[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cur.description], cur.fetchall())


def test_queries_without_sql_have_tests_of_their_own():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"page_formulas", "script_fixes", "code_lines"}  # each has a test file
