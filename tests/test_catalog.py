"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from quern import catalog

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.environ.get('TEST_SF_DIR', SF)}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(repr(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, os.environ.get("TEST_SF_DIR", SF))
    mine = rows_of(found.columns, [tuple(r) for r in found.collect()])
    if name not in catalog.ORACLE_SQL:
        return
    said = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in said.description]
    assert sorted(columns) == sorted(found.columns)
    theirs = rows_of(columns, said.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs


def test_tfidf_cosine_counts_terms_once(spark, monkeypatch):
    from quern.plans import search_queries

    calls = []
    monkeypatch.setattr(search_queries, "written", lambda df, write=search_queries.written: calls.append(df.columns) or write(df))
    assert search_queries.tfidf_cosine(spark, SF).count() > 0 and calls == [["doc_id", "term", "w"]]
