from __future__ import annotations

import math
import random
import statistics
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from vitrine.functions.numbers import exact_sum
from vitrine.operators.stats import price_stats

SCHEMA = "category string, price double"


def mean_of(known):
    if any(map(math.isinf, known)):
        return sum(known)
    return float(sum(map(Fraction, known)) / len(known))


def brute(rows):
    groups = {}
    for category, price, *times in rows:
        if category is not None:
            groups.setdefault(category, []).extend([price] * (times[0] if times else 1))
    out = {}
    for category, values in groups.items():
        known = sorted(v for v in values if v is not None)
        if known:
            out[category] = (known[0], known[-1], mean_of(known), statistics.median(known))
        else:
            out[category] = (None, None, None, None)
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for key, values in want.items():
        for mine, theirs in zip(got[key], values):
            assert (mine is None) == (theirs is None), (key, got[key], values)
            if theirs is not None:
                assert math.isclose(mine, theirs, rel_tol=1e-9), (key, got[key], values)


def run(spark, rows, schema=SCHEMA, **more):
    frame = spark.createDataFrame(rows, schema)
    return {r["category"]: tuple(r)[1:] for r in price_stats(frame, ["category"], **more).collect()}


def test_groups_of_every_kind(spark):
    rows = (
        [("even", float(v)) for v in (4, 1, 3, 2)]
        + [("odd", float(v)) for v in (9, 1, 5)]
        + [("one", 7.5), ("none", None), ("none", None), (None, 3.0)]
        + [("mixed", v) for v in (None, -2.0, 0.0, 0.0, 1e-9, 1e12, None)]
        + [("negative", v) for v in (-1.0, -1e6, -3.5, -3.4)]
    )
    same(run(spark, rows), brute(rows))


def test_one_group_holds_most_rows_and_one_value_most_of_it(spark):
    dice = random.Random(3)
    rows = [("hot", 5.0)] * 3000 + [("hot", round(dice.uniform(0, 1e5), 2)) for _ in range(2000)]
    rows += [(f"c{i % 40}", round(dice.uniform(1, 50), 2)) for i in range(400)]
    dice.shuffle(rows)
    same(run(spark, rows), brute(rows))


def test_weights(spark):
    rows = [("a", 1.0, 5), ("a", 2.0, 1), ("a", 9.0, 5), ("b", None, 2), ("b", 4.0, 1)]
    got = run(spark, rows, SCHEMA + ", times int", weight="times")
    same(got, brute(rows))


def test_infinite_prices(spark):
    low, high, mean, median = run(spark, [("a", math.inf), ("a", 1.0), ("a", 2.0)])["a"]
    assert (low, high, mean, median) == (1.0, math.inf, math.inf, 2.0)


def test_empty_input(spark):
    assert run(spark, []) == {}


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["a", "b", "c"]),
            st.none() | st.floats(-1e6, 1e6, allow_nan=False, allow_subnormal=False),
        ),
        min_size=1,
        max_size=40,
    )
)
def test_any_values(spark, rows):
    got = run(spark, rows)
    same(got, brute(rows))
    assert all(low <= mean <= high for low, high, mean, _ in got.values() if mean is not None)


@pytest.mark.parametrize(
    "values",
    [
        [4e-7] * 10,
        [5e-8, 1.0],
        [1e22, 0.01, 4e-7],
        [1e22, -1e22, 12.34],
        [0.1, 0.1, 0.1],
        [1e-300, 3e-300],
        [math.inf, 4e-7, 1e22],
        [19.99, 5.01, 1e9, 0.000001],
    ],
)
def test_no_digit_is_lost(spark, values):
    low, high, mean, _ = run(spark, [("a", v) for v in values])["a"]
    assert math.isclose(mean, mean_of(values), rel_tol=1e-15) and low <= mean <= high
    total = spark.createDataFrame([(v,) for v in values], "v double").agg(exact_sum(F.col("v")))
    assert math.isclose(total.first()[0], math.fsum(values), rel_tol=1e-15)


def test_keys_of_two_columns(spark):
    frame = spark.createDataFrame(
        [("p", "x", 1.0), ("p", "x", 3.0), ("p", None, 5.0), ("q", "x", 2.0)],
        "product_id string, category string, price double",
    )
    got = price_stats(frame, ["product_id", "category"]).collect()
    assert sorted((r[0], r[1], r["median_price"]) for r in got) == [("p", "x", 2.0), ("q", "x", 2.0)]


@pytest.mark.parametrize("parts", [1, 7])
def test_result_does_not_depend_on_partitions(spark, parts):
    rows = [(f"c{i % 3}", (i * 37 % 101) / 4) for i in range(300)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = {r["category"]: tuple(r)[1:] for r in price_stats(frame, ["category"]).collect()}
    same(got, brute(rows))
