"""The text queries that SQL can express, against their SQL in DuckDB."""

import duckdb
import pytest

from barloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = registry.queries()[name](spark, sf), con.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    found = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(found, key=str) == sorted(want.select(*columns).fetchall(), key=str)
