"""The entry point, with every query that has SQL compared on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from stridemap.plans.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def canonical(rows):
    def value(x):
        if x is None or x != x:
            return None
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return round(float(x), 6)
        return x

    return sorted((tuple(value(x) for x in row) for row in rows), key=repr)


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES.split():
        path = f"{SMALL}/{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sql, name):
    frame = QUERIES[name](spark, SMALL)
    columns = sorted(frame.columns)
    got = canonical(tuple(r) for r in frame.select(*columns).collect())
    found = sql.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == canonical(tuple(r[k] for k in order) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
