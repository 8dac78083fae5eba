"""Every query with SQL gives what DuckDB gives, over the smallest supplied tables."""

import decimal
from pathlib import Path

import duckdb
import pytest

from watchfold import catalog, catalog_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    return value


@pytest.mark.parametrize("name", sorted(catalog_sql.ORACLE))
def test_query_equals_its_sql(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    cursor = tables.execute(catalog_sql.ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    plain = lambda rows: sorted((tuple(map(_plain, r)) for r in rows), key=repr)
    assert plain(df.select(*columns).collect()) == plain(cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog_sql.ORACLE)))
def test_other_queries_run(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert all(len(r) == len(df.columns) for r in df.collect())  # the whole job runs
