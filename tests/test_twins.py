"""Every registered query against its SQL twin on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_DIR, TABLES

QUERIES, TWINS = entry.queries(), entry.oracle_sql()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    got = rows_of(df.columns, df.collect())
    assert got or name == "wait_stats_none"
    if name not in TWINS:
        return
    cursor = duck.execute(TWINS[name])
    columns = {c[0]: str(c[1]) for c in cursor.description}
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(list(columns), cursor.fetchall()) == got
    assert {f.name: KINDS[f.dataType.simpleString()] for f in df.schema} == columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(QUERIES)
