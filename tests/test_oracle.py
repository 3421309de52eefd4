"""Every query of the catalogue against its SQL in DuckDB."""

import datetime
import math
import os

import duckdb
import pytest

from barloom.plans import catalog

SF = os.environ.get("BARLOOM_TEST_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, datetime.datetime):
        return (2, v.replace(tzinfo=None).isoformat())
    if isinstance(v, int | float):
        return (3, round(float(v), 5) + 0.0)
    return (4, str(v))


def rows(columns, found):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(cell(r[i]) for i in at) for r in found])


def same(a, b):
    return a == b or (a[0] == b[0] == 3 and math.isclose(a[1], b[1], rel_tol=1e-6, abs_tol=2e-5))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    want = db.sql(catalog.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    assert all(same(x, y) for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True)), next((p, q) for p, q in zip(a, b, strict=True) if not all(map(same, p, q)))
