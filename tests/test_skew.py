"""Histories and joins of hot keys give the same rows as the plain plan."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import EAGER, OFF, rows_of
from vitrine.operators.joins import listings_with_facts
from vitrine.operators.panel import any_per_key, last_per_key, with_previous
from vitrine.operators.skew import SLICE, SkewPolicy, plan_slices, plan_spread

SCHEMA = "url_id string, created timestamp_ntz, id long, quantity double, price double"


@pytest.fixture(scope="module")
def facts(spark):
    dice = random.Random(11)
    start = datetime(2024, 1, 1)
    rows = []
    for number in range(900):
        key = "hot" if number % 3 == 0 else f"u{dice.randrange(60)}"
        # Few different times, so that ties and rows of equal time at a border are common.
        time = start + timedelta(hours=dice.randrange(200))
        quantity = dice.choice([None, 1.0, 2.0, 5.0, 9.0])
        rows.append((key, time, number, quantity, dice.choice([None, 1.5, 2.5])))
    rows += [(None, start, 1000 + n, float(n), 1.0) for n in range(30)]
    return spark.createDataFrame(rows, SCHEMA)


def brute_previous(facts):
    history = {}
    out = []
    for row in sorted(facts.collect(), key=lambda r: (r["created"], r["id"])):
        key = row["url_id"]
        before = history.get(key, (None, None)) if key is not None else (None, None)
        out.append((row["id"], *before))
        history[key] = (row["quantity"], row["price"])
    return sorted(out)


POLICIES = [
    OFF,
    EAGER,
    SkewPolicy(min_rows=100, hits=100, oversplit=8),
    SkewPolicy(min_rows=50, hits=25, oversplit=3),
    SkewPolicy(min_rows=1, oversplit=50),
]


@pytest.mark.parametrize("policy", POLICIES)
def test_previous_values(spark, facts, policy):
    got = with_previous(
        facts, ["url_id"], "created", ["id"], {"q0": "quantity", "p0": "price"}, policy=policy
    )
    assert sorted(tuple(r) for r in got.select("id", "q0", "p0").collect()) == brute_previous(facts)


@pytest.mark.parametrize("kind", ["timestamp", "date"])
def test_previous_values_of_other_time_types(spark, facts, kind):
    typed = facts.where("url_id is not null").withColumn("created", F.col("created").cast(kind))
    got, want = (
        with_previous(typed, ["url_id"], "created", ["id"], {"q0": "quantity"}, policy=policy)
        .select("id", "q0")
        .collect()
        for policy in (EAGER, OFF)
    )
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_previous_values_by_two_keys(spark, facts):
    branded = facts.withColumn("brand", F.when(F.col("id") % 5 != 0, F.col("id") % 2))
    got, want = (
        with_previous(
            branded, ["url_id", "brand"], "created", ["id"], {"q0": "quantity"}, policy=policy
        )
        .select("id", "q0")
        .collect()
        for policy in (EAGER, OFF)
    )
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    nulls = branded.where("brand is null or url_id is null").select("id").collect()
    known = dict(map(tuple, got))
    assert all(known[row["id"]] is None for row in nulls)


def test_only_keys_above_the_bar_are_hot(spark, facts):
    policy = SkewPolicy(min_rows=100, hits=100, oversplit=8)
    slices = plan_slices(facts, ["url_id"], "created", policy)
    hot = slices.hot.collect()
    assert [row["url_id"] for row in hot] == ["hot"]
    # 300 rows against a bar of 100: three shares, each split eightfold, over 32 intervals.
    assert hot[0]["_parts"] == 1
    assert len(hot[0]["_bounds"]) == 33
    sizes = slices.label(facts).where("url_id = 'hot'").groupBy(SLICE).count().collect()
    assert len(sizes) > 12 and max(row["count"] for row in sizes) < 60
    assert not plan_slices(facts, ["url_id"], "created").any


def test_slices_follow_time(spark, facts):
    slices = plan_slices(facts, ["url_id"], "created", EAGER)
    rows = slices.label(facts.where("url_id = 'hot'")).orderBy("created").select(SLICE).collect()
    numbers = [row[0] for row in rows]
    assert numbers == sorted(numbers)


def test_a_burst_in_a_long_time_is_split(spark):
    burst = spark.range(1000).selectExpr(
        "'hot' as url_id",
        "id",
        """timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, cast(id as decimal(18,6)))
           + make_dt_interval(case when id = 999 then 3000 else 0 end, 0, 0, 0) as created""",
    )
    policy = SkewPolicy(min_rows=100, hits=100, oversplit=8)
    slices = plan_slices(burst, ["url_id"], "created", policy)
    sizes = [row["count"] for row in slices.label(burst).groupBy(SLICE).count().collect()]
    # All rows but one are in the first 17 minutes of eight years.
    assert sum(sizes) == 1000 and max(sizes) <= 70


def test_copies_meet_every_slice_and_others_stay_single(spark, facts):
    policy = SkewPolicy(min_rows=100, hits=100, oversplit=8)
    slices = plan_slices(facts, ["url_id"], "created", policy)
    listings = spark.createDataFrame([("hot",), ("u1",), ("none",), (None,)], "url string")
    copies = slices.copy_to_slices(listings, ["url"]).groupBy("url").count().collect()
    assert {r["url"]: r["count"] for r in copies} == {"hot": 32, "u1": 1, "none": 1, None: 1}


@pytest.mark.parametrize("scale", [1, 10, 100])
def test_the_bar_does_not_rise_with_the_table(spark, scale):
    """A key of 500 rows is hot in tables of any size, and its slices stay small."""
    rows = spark.range(1000 * scale).selectExpr(
        "case when id < 500 then 'hot' else 'k' || id div 20 end as url_id",
        "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(id % 500 as int)) as created",
        "id",
    )
    policy = SkewPolicy(min_rows=100, hits=100, oversplit=8)
    slices = plan_slices(rows, ["url_id"], "created", policy, ["id"])
    assert [r["url_id"] for r in slices.hot.collect()] == ["hot"]
    sizes = slices.label(rows).where("url_id = 'hot'").groupBy(SLICE).count().collect()
    assert max(r["count"] for r in sizes) <= 100


def test_rows_of_one_second_are_split(spark):
    rows = spark.range(5000).selectExpr(
        "'hot' as url_id", "timestamp_ntz'2024-01-01' as created", "(id * 7919) % 5000 as id"
    ).withColumn("quantity", F.col("id").cast("double"))
    policy = SkewPolicy(min_rows=100, hits=100, oversplit=8)
    slices = plan_slices(rows, ["url_id"], "created", policy, ["id"])
    sizes = [r["count"] for r in slices.label(rows).groupBy(SLICE).count().collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 400
    got = with_previous(rows, ["url_id"], "created", ["id"], {"q0": "quantity"}, policy=policy)
    before = {r["id"]: r["q0"] for r in got.collect()}
    assert before == {n: float(n - 1) if n else None for n in range(5000)}
    spread = plan_spread(rows, "url_id", policy)
    sizes = [r["count"] for r in spread.label(rows).groupBy(SLICE).count().collect()]
    assert max(sizes) <= 400


@pytest.mark.parametrize("wrong", [{"min_rows": 0}, {"hits": 0}, {"oversplit": 0}])
def test_a_policy_is_checked(wrong):
    with pytest.raises(ValueError):
        SkewPolicy(**wrong)


def test_slices_found_once_serve_again(spark, facts):
    policy = SkewPolicy(min_rows=50, oversplit=3)
    slices = plan_slices(facts, ["url_id"], "created", policy, ["id"])
    got = with_previous(facts, ["url_id"], "created", ["id"], {"q0": "quantity"}, slices=slices)
    want = with_previous(facts, ["url_id"], "created", ["id"], {"q0": "quantity"}, policy=OFF)
    assert rows_of(got.drop(SLICE)) == rows_of(want)


@pytest.mark.parametrize("policy", [OFF, EAGER])
def test_rows_without_a_key_do_not_meet_in_a_full_join(spark, policy):
    facts = spark.range(4000).selectExpr(
        "case when id % 2 = 0 then 'u' || id % 100 end as url_id",
        "timestamp_ntz'2024-01-01' as created", "id",
    ).repartition(8)
    listings = spark.range(60).selectExpr("case when id < 50 then 'u' || id end as url", "id as seller")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = listings_with_facts(listings, facts, "full_outer", policy=policy)
    want = listings.join(facts, F.col("url") == F.col("url_id"), "full_outer")
    assert rows_of(got) == rows_of(want)
    held = got.groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in held) < 0.4 * sum(r["count"] for r in held)


@pytest.mark.parametrize("how", ["inner", "left", "full_outer"])
@pytest.mark.parametrize("policy", POLICIES[1:])
def test_joins(spark, facts, how, policy):
    listings = spark.createDataFrame(
        [("hot", 1), ("u1", 2), ("u2", 3), ("never seen", 4), (None, 5)], "url string, seller int"
    )
    got = listings_with_facts(listings, facts, how, policy=policy)
    want = listings.join(facts, F.col("url") == F.col("url_id"), how)
    assert rows_of(got) == rows_of(want)


def test_join_refuses_equal_names(spark, facts):
    listings = spark.createDataFrame([("hot", 1)], "url string, price int")
    with pytest.raises(ValueError, match="price"):
        listings_with_facts(listings, facts, "left", policy=EAGER)


def test_values_spread_over_a_key(spark, facts):
    flagged = facts.withColumn("big", F.coalesce(F.col("quantity") > 8, F.lit(False)))
    got = any_per_key(flagged, "url_id", "big", "any").select("id", "url_id", "any").collect()
    rows = flagged.collect()
    for row in got:
        if row["url_id"] is not None:
            assert row["any"] == any(r["big"] for r in rows if r["url_id"] == row["url_id"])
    last = last_per_key(facts, "url_id", "price", "created", ["id"], "last").collect()
    newest = {}
    for row in sorted(rows, key=lambda r: (r["created"], r["id"])):
        newest[row["url_id"]] = row["price"]
    assert len(last) == len(rows)
    for row in last:
        if row["url_id"] is not None:
            assert row["last"] == newest[row["url_id"]]


def test_empty_facts(spark, facts):
    empty = facts.where("1 = 0")
    got = with_previous(empty, ["url_id"], "created", ["id"], {"q0": "quantity"}, policy=EAGER)
    assert got.count() == 0
