"""The report kept up day by day equals the one over all observations."""

from __future__ import annotations

import random
from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import EAGER, OFF, rows_of
from vitrine.plans.config import Scope
from vitrine.plans.histories import DRAFT_RULES, FINAL_RULES, FlowRules
from vitrine.plans.incremental import DayStore
from vitrine.plans.stock_flow import stock_flow_report
from vitrine.session import work_dir

SCHEMA = "url_id string, created timestamp_ntz, id long, available_quantity string, price string"
SCOPE = Scope(as_of=date(2024, 1, 8), lookback_days=30, targets=None, tiebreak=("id",), one_row_per_listing=True, skew=OFF)


@pytest.fixture(scope="module")
def facts(spark):
    dice = random.Random(8)
    rows = []
    for number in range(600):
        key = "hot" if number % 3 == 0 else f"u{dice.randrange(40)}"
        time = datetime(2024, 1, 1) + timedelta(hours=dice.randrange(24 * 8), minutes=dice.randrange(3))
        rows.append((key, time, number, dice.choice(["n/a", "1", "2", "5", "9"]), dice.choice(["", "1.5", "2.5"])))
    rows += [(None, datetime(2024, 1, 5), 5000, "1", "1"), ("u1", None, 5001, "1", "1")]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def listings(spark):
    rows = [(f"u{n}", '[{"name":"A"},{"name":"%d"}]' % (n % 3)) for n in range(45)]
    return spark.createDataFrame([*rows, ("hot", '[{"name":"A"}]')], "url string, breadcrumbs string")


def known(facts):
    return facts.where("url_id is not null and created is not null")


def check(store, listings, facts, scope, rules):
    want = stock_flow_report(listings, known(facts), scope, rules)
    assert rows_of(store.report(listings, scope)) == rows_of(want)


@pytest.mark.parametrize(
    "period, rules, policy",
    [
        ("day", FINAL_RULES, OFF),
        ("month", replace(DRAFT_RULES, unmatched=False), OFF),
        ("month", FlowRules(unit="product", fill="zero"), EAGER),
    ],
)
def test_days_loaded_one_by_one(spark, listings, facts, period, rules, policy):
    """After every load the report is that of all loaded so far, at every look-back."""
    store = DayStore(spark, work_dir(spark), SCHEMA, ("id",), period, rules, policy)
    assert store.report(listings, SCOPE).count() == 0
    late = F.col("id") % 11 == 0
    border = F.lit(datetime(2024, 1, 5))
    parts = [~late & (F.col("created") < border), ~late & (F.col("created") >= border), late]
    loaded = facts.limit(0)
    for part in parts:
        assert store.load(facts.where(part)) > 0
        loaded = loaded.unionByName(facts.where(part))
        check(store, listings, loaded, SCOPE, rules)
    assert store.load(facts.where("id % 2 = 0")) == 0  # delivered again
    for days in (1, 4):
        check(store, listings, facts, replace(SCOPE, lookback_days=days), rules)
    assert rows_of(store.observations()) == rows_of(known(facts))


def test_a_late_row_touches_its_day_only(spark, facts):
    store = DayStore(spark, work_dir(spark), SCHEMA, ("id",))
    store.load(facts)
    before = store.manifest()
    late = spark.createDataFrame([("u1", datetime(2024, 1, 3, 1, 30, 7), 9000, "3", "1")], SCHEMA)
    assert store.load(late) == 1
    after = store.manifest()
    assert {d for d in after.sums if after.sums[d] != before.sums.get(d)} == {"2024-01-03"}
    assert store.observations().count() == known(facts).count() + 1


def test_a_load_that_broke_off_is_not_read(spark, listings, facts):
    """Files of a load without its manifest count for nothing, and the load can be made again."""
    store = DayStore(spark, work_dir(spark), SCHEMA, ("id",))
    store.load(facts.where("id < 300"))
    rest = facts.where("id >= 300")
    broken = rest.withColumn("period", F.to_date("created"))
    broken.where("id < 400").write.partitionBy("period").parquet(f"{store.path}/observations/load=2")
    check(store, listings, facts.where("id < 300"), SCOPE, FINAL_RULES)
    store.load(rest)
    check(store, listings, facts, SCOPE, FINAL_RULES)


def test_a_load_writes_few_files_however_many_tasks(spark, facts):
    """Observations are dealt to their periods before they are written, so each period is one file here."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        store = DayStore(spark, work_dir(spark), SCHEMA, ("id",))
        assert store.load(facts.where("id % 2 = 0")) == 8
        assert len(store.observations().inputFiles()) == 8
        assert store.load(facts) == 8
        assert len(store.observations().inputFiles()) == 16
    finally:
        spark.conf.set(key, before)
    assert rows_of(store.observations()) == rows_of(known(facts))
