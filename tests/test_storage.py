"""Observations stored by listing: results, plans, and the summary of hot listings."""

from __future__ import annotations

import random
import re
from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA, EAGER, OFF, rows_of
from tests.test_plans import no_broadcast, plan_text  # noqa: F401
from vitrine.operators.joins import listings_with_facts
from vitrine.operators.panel import with_previous
from vitrine.operators.skew import SLICE, SkewPolicy, find_hot_keys, plan_spread
from vitrine.plans.config import Scope
from vitrine.plans.stock_flow import stock_flow_report
from vitrine.registry.params import SCOPE, TIE
from vitrine.registry.stored import stored_steps, stored_stock_flow
from vitrine.registry.tables import Tables
from vitrine.session import work_dir
from vitrine.storage.hot_keys import ERROR, frequent_keys, hot_from_summary, summarize
from vitrine.storage.observations import open_observations, store_observations

SCHEMA = "url_id string, created timestamp_ntz, id long, available_quantity string, price string"
WHOLE = Scope(as_of=date(2024, 1, 20), lookback_days=30, targets=None, tiebreak=("id",), one_row_per_listing=True)


@pytest.fixture(scope="module")
def facts(spark):
    dice = random.Random(3)
    rows = []
    for number in range(1200):
        key = "hot" if number % 3 == 0 else f"u{dice.randrange(80)}"
        time = datetime(2024, 1, 1) + timedelta(hours=dice.randrange(500))
        quantity = dice.choice(["n/a", "1", "2", "5", "9"])
        rows.append((key, time, number, quantity, dice.choice(["", "1.5", "2.5"])))
    rows += [(None, datetime(2024, 1, 5), 5000 + n, "1", "1") for n in range(20)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def listings(spark):
    rows = [(f"u{n}", '[{"name":"A"},{"name":"%d"}]' % (n % 3)) for n in range(90)]
    return spark.createDataFrame([*rows, ("hot", '[{"name":"A"}]')], "url string, breadcrumbs string")


POLICIES = [OFF, SkewPolicy(min_rows=100, oversplit=8), EAGER]


@pytest.mark.parametrize("policy", POLICIES)
def test_report_equals_that_of_plain_rows(spark, listings, facts, policy):
    table = store_observations(facts, work_dir(spark), 4, tiebreak=["id"], policy=policy)
    assert table.layout.sliced == policy.enabled
    got = stock_flow_report(listings, table.since(date(2023, 12, 21)), table.scope(WHOLE))
    assert rows_of(got) == rows_of(stock_flow_report(listings, facts, replace(WHOLE, skew=OFF)))
    assert table.unkeyed.count() == 20 and table.rows.count() == 1200
    table.close()


@pytest.mark.parametrize("policy", POLICIES[:2])
def test_another_session_and_appended_days(spark, listings, facts, policy):
    old = facts.where("created < timestamp_ntz'2024-01-15' or url_id is null")
    first = store_observations(old, work_dir(spark), 4, tiebreak=["id"], policy=policy)
    first.append(facts.where("created >= timestamp_ntz'2024-01-15' and url_id is not null"))
    first.close()
    table = open_observations(spark, first.path)
    assert rows_of(table.rows.drop(SLICE)) == rows_of(facts.where("url_id is not null"))
    got = stock_flow_report(listings, table.since(date(2024, 1, 1)), table.scope(WHOLE))
    assert rows_of(got) == rows_of(stock_flow_report(listings, facts, replace(WHOLE, skew=OFF)))
    counts = {r["url_id"]: r["_rows"] for r in table.outgrown(SkewPolicy(min_rows=200)).collect()}
    assert counts == ({} if table.layout.sliced else {"hot": 400.0})
    table.close()


def test_no_bucket_holds_a_hot_listing(spark, facts):
    policy = SkewPolicy(min_rows=100, oversplit=8)
    table = store_observations(facts, work_dir(spark), 8, tiebreak=["id"], policy=policy)
    held = table.rows.where("url_id = 'hot'").groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in held) == 400 and max(r["count"] for r in held) < 160


@pytest.mark.parametrize("sliced", [False, True])
def test_the_facts_are_not_shuffled(no_broadcast, sliced):  # noqa: F811
    spark = no_broadcast
    t = Tables(spark, DATA)
    policy = SkewPolicy(min_rows=100, oversplit=8) if sliced else OFF
    table = store_observations(t.observations, work_dir(spark), 4, tiebreak=TIE, policy=policy)
    for frame, shuffles in ((stored_stock_flow(t, table), 2), (stored_steps(t, table), 0)):
        plan = plan_text(frame, "simple")
        assert "Bucketed: true" in plan
        if not sliced:
            # the listings, and the categories at the end
            assert plan.count("Exchange hashpartitioning") == shuffles
        # what is above a scan of observations up to the next join, window or aggregate
        for line in _above(plan, "vitrine_"):
            assert "Exchange" not in line or "_last" in line, line
    table.close()


def _above(plan, scan):
    """The steps from each scan up to the first window, in a tree printed with indents."""
    lines, out = plan.split("\n"), []
    for at, line in enumerate(lines):
        if scan not in line:
            continue
        depth = len(re.match(r"[\s:+\-*()0-9]*", line).group())
        for above in reversed(lines[:at]):
            here = len(re.match(r"[\s:+\-*()0-9]*", above).group())
            if here < depth:
                depth = here
                out.append(above)
                if "Window" in above or "Aggregate" in above:
                    break
    return out


def test_a_look_back_reads_its_months(spark, facts):
    table = store_observations(facts, work_dir(spark), 2, tiebreak=["id"], policy=OFF)
    plan = plan_text(table.since(date(2024, 1, 10)))
    assert re.search(r"PartitionFilters: \[.*_month.*2024-01-01", plan)
    assert table.since(date(2024, 1, 10)).count() == facts.where(
        "created >= timestamp_ntz'2024-01-10' and url_id is not null"
    ).count()


def test_no_job_while_a_plan_is_built(spark, listings, facts):
    """Hot listings of a look-back come from the summary, slices from the stored layout."""
    path = work_dir(spark)
    summarize(facts, "url_id", "created").write.parquet(path)
    hot = hot_from_summary(spark.read.parquet(path), "url_id", SkewPolicy(min_rows=100))
    table = store_observations(facts, work_dir(spark), 4, tiebreak=["id"], policy=EAGER)
    rows, slices = table.rows, table.scope(WHOLE)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "building")
    joined = listings_with_facts(listings, facts, "left", policy=SkewPolicy(min_rows=100), hot=hot)
    report = stock_flow_report(listings, rows, slices)
    assert list(tracker.getJobIdsForGroup("plan")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = listings.join(facts, F.col("url") == F.col("url_id"), "left")
    assert rows_of(joined) == rows_of(want)
    assert report.count() > 0
    spread = plan_spread(facts, "url_id", SkewPolicy(min_rows=100), hot)
    sizes = [r["count"] for r in spread.label(facts).groupBy("url_id", SLICE).count().collect()]
    assert max(sizes) < 100


def test_summaries_merge_within_their_error(spark):
    """Few counters, many keys: no frequent key is missed, and counts are off by the bound at most."""
    rows = spark.range(60_000).selectExpr(
        "case when id % 3 = 0 then 'hot' when id % 10 = 1 then 'warm' else 'k' || id % 7000 end as k",
        "timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 7 as int)) as created",
    )
    tracked = 1024
    summary = summarize(rows, "k", "created", tracked)
    assert summary.count() == 7
    for since, until in ((None, None), (date(2024, 1, 2), date(2024, 1, 5)), (date(2024, 1, 7), None)):
        days = rows
        days = days.where(F.to_date("created") >= F.lit(since)) if since else days
        days = days.where(F.to_date("created") < F.lit(until)) if until else days
        total = days.count()
        true = {r["k"]: r["count"] for r in days.groupBy("k").count().collect()}
        bar = total // 20
        found = {r["k"]: r["_rows"] for r in frequent_keys(summary, "k", bar, since, until, tracked).collect()}
        assert {k for k, n in true.items() if n >= bar} <= set(found)
        for key, n in found.items():
            assert abs(n - true[key]) <= ERROR / tracked * total
            assert true[key] >= bar - 2 * ERROR / tracked * total
    assert frequent_keys(summary, "k", 1, date(2030, 1, 1), None, tracked).count() == 0


def test_the_search_reads_the_keys_only(spark):
    rows = spark.read.parquet(f"{DATA}/lineitem.parquet")
    executed = []
    known = rows.select("l_partkey").where("l_partkey is not null")
    executed.append(plan_text(SkewPolicy().thin(known).groupBy("l_partkey").count()))
    assert re.findall(r"ReadSchema: struct<([^>]*)>", executed[0]) == ["l_partkey:bigint"]
    assert find_hot_keys(rows, ["l_partkey"], SkewPolicy()) is None


def test_an_empty_table(spark, listings, facts):
    table = store_observations(facts.limit(0), work_dir(spark), 2, tiebreak=["id"])
    assert table.rows.count() == 0 and not table.layout.sliced
    assert stock_flow_report(listings, table.rows, table.scope(WHOLE)).count() == 0
    steps = with_previous(
        table.rows, ["url_id"], "created", ["id"], {"before": "price"}, slices=table.slices, null_keys=False
    )
    assert steps.count() == 0
    assert SCOPE.slices is None
