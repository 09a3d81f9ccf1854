"""Every registered query with SQL gives the same rows and column types as DuckDB does."""

import duckdb
import pytest

from ringfold.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(repr(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(name, spark, sf, duck):
    df = catalog.queries()[name](spark, sf)
    wanted = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    assert {n: KINDS.get(t, t) for n, t in df.dtypes} == {n: str(t) for n, t in zip(wanted.columns, wanted.types, strict=True)}
    rows = df.collect()
    assert rows
    assert canonical(rows, df.columns) == canonical(wanted.fetchall(), wanted.columns)
