"""Every registered query against its SQL, run by another engine on the same files."""

from __future__ import annotations

import math

import duckdb
import pytest

from tests.conftest import DATA
from vitrine.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def other():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return connection


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(value)
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(row[i]) for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, other, name):
    frame = QUERIES[name](spark, DATA)
    check = other.sql(ORACLES[name])
    assert sorted(frame.columns) == sorted(check.columns)
    rows = frame.collect()
    assert rows, "an empty result checks nothing"
    assert table(frame.columns, rows) == table(check.columns, check.fetchall())
