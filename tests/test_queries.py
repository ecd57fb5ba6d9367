"""Every query with SQL gives what DuckDB gives."""

import duckdb
import pytest

from hushframe.plans import queries as Q

TABLES = ["customer", "documents", "pages", "conversations", "benchmark", "labels", "embeddings"]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_equals_sql(spark, sf, duck, name):
    df = Q.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    rel = duck.sql(Q.SQL[name])
    assert sorted(rel.columns) == cols
    assert got == sorted(repr(tuple(row[rel.columns.index(c)] for c in cols)) for row in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, sf, name):
    assert Q.QUERIES[name](spark, sf).columns


def test_letters_are_masked_whole(spark, sf):
    """Both modes mask all findings of a letter."""
    found = {r[0]: r[1] for r in Q.QUERIES["entities_over_letters"](spark, sf).groupBy("doc_id").count().collect()}
    for mode in ("safe", "compat"):
        assert {r.doc_id: r.n for r in Q.QUERIES[f"letters_masked_{mode}"](spark, sf).collect()} == found


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
