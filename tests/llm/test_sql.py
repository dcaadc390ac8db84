"""The registered numbered queries that SQL can say, against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from sievework.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_by_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    found = __spark_entry__.queries()[name](spark, sf_dir)
    columns = sorted(found.columns)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    got = sorted(tuple(str(r[c]) for c in columns) for r in found.collect())
    assert got
    assert got == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in want.fetchall())
