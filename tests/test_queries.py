"""Every query against its SQL twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from conftest import SF
from rowsieve.plans.oracle import ORACLE_SQL
from rowsieve.plans.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLE_SQL) <= set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(ORACLE_SQL[name])
    kinds = {d[0]: str(d[1]).upper() for d in result.description}
    names = list(kinds)
    assert sorted(names) == columns
    want = sorted((tuple(row[names.index(c)] for c in columns) for row in result.fetchall()), key=repr)
    assert got == want
    assert {c: TYPES[df.schema[c].dataType.simpleString()] for c in columns} == kinds


def test_entry(spark):
    assert entry_points.entry(spark).count() == 2
