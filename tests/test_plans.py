"""What the plans of the registered queries look like."""

from __future__ import annotations

import re

import pytest

from datetime import date

from tests.conftest import DATA, EAGER, OFF, rows_of
from vitrine.registry import ORACLES, QUERIES
from vitrine.registry.tables import Tables
from vitrine.registry.params import EVERYTHING, SCOPE
from vitrine.plans.stock_flow import stock_flow_report
from vitrine.plans.coverage import seller_price_counts
from vitrine.plans.price import price_report, price_report_by_product

HEAVY = sorted(name for name in QUERIES if name.startswith(("report_", "agg_", "win_", "join_")))
# What these give back is a written table; what writes it has tests of its own.
HEAVY = [name for name in HEAVY if not name.endswith(("_streamed", "_incremental"))]


def plan_text(frame, mode="formatted"):
    return frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), mode)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", HEAVY)
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_text(QUERIES[name](spark, DATA), "simple")
    for word in ("PythonUDF", "MapInPandas", "InPandas", "CartesianProduct", "NestedLoop"):
        assert word not in plan, word


@pytest.fixture
def no_broadcast(spark):
    """Joins as they are when neither side is small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_stock_flow_shuffles_the_facts_once(no_broadcast):
    t = Tables(no_broadcast, DATA)
    plan = plan_text(stock_flow_report(t.listings, t.observations, SCOPE), "simple")
    # Listings by url, facts by url for join, window and the listing totals, then categories.
    assert len(re.findall(r"Exchange hashpartitioning\(url#", plan)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\(url_id#", plan)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\(category#", plan)) == 1
    assert plan.count("Exchange hashpartitioning") == 3


def test_price_report_reads_the_facts_once(no_broadcast):
    t = Tables(no_broadcast, DATA)
    plan = plan_text(price_report(t.listings, t.observations, SCOPE), "simple")
    assert plan.count("FileScan parquet") == 2
    assert "ReusedExchange" in plan


def test_look_back_and_columns_reach_the_scan(spark):
    t = Tables(spark, DATA)
    plan = plan_text(price_report(t.listings, t.observations, SCOPE))
    assert "GreaterThanOrEqual(l_shipdate,1999-07-01" in plan
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert not any("l_comment" in s or "l_tax" in s or "l_suppkey" in s for s in schemas)


def test_left_join_with_a_filter_on_the_right_becomes_inner(spark):
    plan = plan_text(QUERIES["flt_post_left_join"](spark, DATA), "simple")
    assert "LeftOuter" not in plan and "Inner" in plan


def test_latest_rows_are_cut_in_every_task(spark):
    plan = plan_text(QUERIES["topk_latest"](spark, DATA), "simple")
    assert "TakeOrderedAndProject" in plan


def test_one_day_reaches_the_scan(spark):
    plan = plan_text(QUERIES["flt_date_eq"](spark, DATA))
    assert "GreaterThanOrEqual(ts,2024-01-17" in plan and "LessThan(ts,2024-01-18" in plan


def test_seller_prices_take_one_pass_over_the_facts(no_broadcast):
    t = Tables(no_broadcast, DATA)
    plan = plan_text(seller_price_counts(t.listings, t.observations, EVERYTHING), "simple")
    assert len(re.findall(r"FileScan parquet \[l_", plan)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\(url_id#", plan)) == 1


def test_looked_up_revenue_reads_the_facts_once_more_for_the_output(no_broadcast):
    plan = plan_text(QUERIES["map_lookup"](no_broadcast, DATA), "simple")
    assert len(re.findall(r"FileScan parquet \[l_", plan)) == 2


def test_product_prices_shuffle_the_facts_twice(no_broadcast):
    plan = plan_text(QUERIES["agg_price_by_product"](no_broadcast, DATA), "simple")
    # Listings and facts by url, then everything by product.
    assert plan.count("Exchange hashpartitioning") == 3
    assert len(re.findall(r"FileScan parquet \[l_", plan)) == 1


@pytest.mark.parametrize("policy", [EAGER, OFF])
def test_hot_products_give_the_same(spark, policy):
    t = Tables(spark, DATA)
    days = (date(1996, 1, 15), date(1999, 2, 15))
    got = price_report_by_product(t.listings, t.observations, *days, policy=policy)
    want = price_report_by_product(t.listings, t.observations, *days)
    assert rows_of(got) == rows_of(want)


def test_a_window_by_key_serves_later_steps(no_broadcast):
    plan = plan_text(QUERIES["win_any"](no_broadcast, DATA), "simple")
    assert "_w0" not in plan
