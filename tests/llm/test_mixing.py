from __future__ import annotations

import math
import os
import sys

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm import brute
from tests.test_queries import table as sorted_table
from vitrine.llm import mixing, queries

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.mark.parametrize("name", ["op4_capped_mixing", "op9_site_line_dedup"])
def test_sql(workers, name):
    other = duckdb.connect()
    other.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    frame, check = queries.QUERIES[name](workers, DATA), other.sql(queries.ORACLES[name])
    assert sorted(frame.columns) == sorted(check.columns)
    assert sorted_table(frame.columns, frame.collect()) == sorted_table(check.columns, check.fetchall())


def fill(workers, sizes, weights, share, epochs):
    rows = [(s, n, weights[s]) for s, n in sizes.items()]
    frame = workers.createDataFrame(rows, "source string, source_size long, weight long")
    return {r["source"]: r["target"] for r in mixing.fill(frame, share, epochs).collect()}


@pytest.mark.parametrize(
    "sizes",
    [[100, 100, 100], [1, 10, 100, 1000, 10_000], [10_000, 1000, 100, 10, 1], [0, 0, 5], [0], [7] * 9],
)
@pytest.mark.parametrize("share", [0.5, 1.5, 2.0, 3.0])
def test_fill(workers, sizes, share):
    named = {f"s{i}": n for i, n in enumerate(sizes)}
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(named)}
    got = fill(workers, named, weights, share, 2)
    expected = brute.fill(named, weights, share, 2)
    assert all(math.isclose(got[s], expected[s], rel_tol=1e-12) for s in named)
    assert all(got[s] <= 2 * named[s] for s in named)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=8))
def test_brute_fill_shares_everything(sizes):
    named = dict(enumerate(sizes))
    weights = {i: (5, 2, 1)[i % 3] for i in named}
    assert math.isclose(sum(brute.fill(named, weights, 1.5, 2).values()), 1.5 * sum(sizes), abs_tol=1e-6)


def test_takes_come_near_targets(workers):
    rows = [(i, "x " * (1 + i * i % 17), f"s{i % 4}" if i > 300 else "hot") for i in range(900)]
    docs = workers.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, mixing.words(F.col("text")))
    found = mixed.collect()
    for source in {r["source"] for r in found}:
        own = [r for r in found if r["source"] == source]
        taken = sum(r["size"] * r["repetitions"] for r in own)
        assert abs(taken - own[0]["target"]) <= max(r["size"] for r in own) / 2
        assert all(0 <= r["repetitions"] <= 2 for r in own)
        assert len({r["target"] for r in own}) == 1
    again = {r["doc_id"]: r["repetitions"] for r in mixing.mix(docs, mixing.words(F.col("text"))).collect()}
    assert again == {r["doc_id"]: r["repetitions"] for r in found}
    assert mixing.repeat(mixed).count() == sum(again.values())


def test_ties_are_taken_one_by_one(workers):
    """Null ids of one size, and repeated rows: as many as the target asks for, as in the SQL."""
    rows = [(i if i % 3 else None, f"{i % 5} y z", f"s{i % 2}") for i in range(600)]
    rows += [(7, "x y", "s2")] * 300 + [(i, "x", "s3") for i in range(50)]
    schema = "doc_id long, text string, source string"
    docs = workers.createDataFrame(rows, schema)
    mixed = mixing.mix(docs, mixing.words(F.col("text")))
    found = mixed.collect()
    assert sorted((r["doc_id"] or 0, r["text"], r["source"]) for r in found) == sorted(
        (i or 0, text, source) for i, text, source in rows
    )
    for source in {r["source"] for r in found}:
        own = [r for r in found if r["source"] == source]
        taken = sum(r["size"] * r["repetitions"] for r in own)
        assert abs(taken - own[0]["target"]) <= max(r["size"] for r in own) / 2
    other = duckdb.connect()
    documents = docs.toPandas().astype({"doc_id": "Int64"})  # noqa: F841  (read by name)
    check = other.sql(queries.MIX_SQL)
    frame = mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("repetitions")).alias("taken")
    )
    assert sorted_table(frame.columns, frame.collect()) == sorted_table(check.columns, check.fetchall())


def test_messy(messy, nothing):
    mixed = mixing.mix(messy, mixing.words(F.col("text")))
    rows = mixed.select("text", "size", "source_size", "repetitions").collect()
    assert len(rows) == messy.count()
    assert all(r["size"] == len(brute.words(r["text"])) for r in rows)
    assert mixing.mix(nothing, mixing.words(F.col("text"))).count() == 0
    assert mixing.repeat(mixed).columns == mixed.columns
