"""Every registered query against its SQL at the smallest scale."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from claimloom.queries.fixtures import TABLES
from claimloom.queries.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def database(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return connection


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        return None if isinstance(v, float) and math.isnan(v) else v

    return sorted(columns), Counter(tuple(value(row[i]) for i in order) for row in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, database, name):
    df = entry.queries()[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    result = database.execute(ORACLES[name])
    expected = rows([c[0] for c in result.description], result.fetchall())
    assert got[0] == expected[0]
    assert got[1] == expected[1], (list((got[1] - expected[1]).items())[:2], list((expected[1] - got[1]).items())[:2])
    assert df.schema == entry.queries()[name](spark, sf_dir).schema


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_no_query_compares_every_pair(spark, sf_dir):
    for name, query in QUERIES.items():
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
