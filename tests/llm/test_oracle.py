"""Queries with SQL give the rows that DuckDB gives."""

import duckdb
import pytest

from quern.llm import queries

from ..conftest import SF


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    said = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in said.description]
    found = queries.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(found.columns)
    assert sorted(said.fetchall()) == sorted(tuple(r) for r in found.select(*columns).collect())
