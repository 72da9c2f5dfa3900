"""Every query with SQL against DuckDB on the same tables."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
SQL, QUERIES = entry.oracle_sql(), entry.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    """A value as both engines give it: numbers that are no floats as integers where they are whole, NaN as missing."""
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, Decimal):
        x = int(x) if x == int(x) else float(x)
    return None if isinstance(x, float) and math.isnan(x) else x if isinstance(x, (int, float)) else str(x)


def rows(columns, found):
    """The names in order, and the rows: those of columns without floats first, so that last digits don't change the order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in found]
    key = lambda r: (str([x for x in r if not isinstance(x, float)]), [f"{x:.6g}" for x in r if isinstance(x, float)])
    return [columns[i] for i in order], sorted(out, key=key)


def equal(x, y):
    if isinstance(x, float) or isinstance(y, float):
        return x is not None and y is not None and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)
    return x == y


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    frame, there = QUERIES[name](spark, SF), duck.execute(SQL[name])
    got, want = rows(frame.columns, frame.collect()), rows([c[0] for c in there.description], there.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1]) > 0
    for a, b in zip(got[1], want[1]):
        assert all(equal(x, y) for x, y in zip(a, b)), (a, b)


def test_entry_and_fragments(spark):
    flagship = entry.entry(spark)
    assert flagship.columns[0] == "cell" and flagship.count() > 0
    got = {r["fua"]: tuple(r)[1:] for r in QUERIES["area_fragments"](spark, SF).collect()}
    assert got == {0: (60, 12, 5, 55), 1: (40, 8, 5, 35)}
