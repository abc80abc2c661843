"""Reports on a small fixture with known results, and the rules they follow."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import EAGER, OFF, rows_of
from vitrine.plans.config import DEFAULT_TARGETS, Scope
from vitrine.plans.coverage import brand_seller_report, raw_brand_report, seller_price_report
from vitrine.plans.extracts import filtered_extract, product_history
from vitrine.plans.price import price_report, price_report_by_product
from vitrine.plans.histories import FlowRules, listing_totals
from vitrine.plans.stock_flow import (
    changed_products_report,
    stock_flow_by_ancestor,
    stock_flow_draft_report,
    stock_flow_report,
)

AUDIO, TABLETS = "electrónica,audio", "computación,tablets"
SCOPE = Scope(
    as_of=date(2024, 1, 3),
    targets=("electrónica", "computación"),
    tiebreak=("id",),
    one_row_per_listing=True,
    skew=OFF,
)
SKEWED = replace(SCOPE, skew=EAGER)


def by(frame, key="category"):
    return {row[key]: row.asDict() for row in frame.collect()}


@pytest.mark.parametrize("scope", [SCOPE, SKEWED])
def test_stock_flow(micro_listings, micro_facts, scope):
    got = by(stock_flow_report(micro_listings, micro_facts, scope))
    assert got[AUDIO] == {
        "category": AUDIO,
        "total_products": 2,
        "products_with_movement": 4,
        "products_with_sales": 1,
        "pct_with_movement": 200.0,
        "pct_with_sales": 50.0,
        "products_with_available_quantity": 2,
        "revenue": 0.0,
        "total_stock": 16.0,
    }
    assert got[TABLETS] == {
        "category": TABLETS,
        "total_products": 1,
        "products_with_movement": 2,
        "products_with_sales": 1,
        "pct_with_movement": 200.0,
        "pct_with_sales": 100.0,
        "products_with_available_quantity": 1,
        "revenue": 165.0,
        "total_stock": 2.0,
    }
    assert len(got) == 2


@pytest.mark.parametrize("scope", [SCOPE, SKEWED])
def test_first_observation_need_not_count(micro_listings, micro_facts, scope):
    rules = FlowRules(first_counts=False)
    got = by(stock_flow_report(micro_listings, micro_facts, scope, rules))
    assert got[AUDIO]["products_with_movement"] == 2
    assert got[TABLETS]["products_with_movement"] == 1


def test_products_instead_of_events(micro_listings, micro_facts):
    rules = FlowRules(unit="product")
    got = by(stock_flow_report(micro_listings, micro_facts, SCOPE, rules))
    assert got[AUDIO]["products_with_movement"] == 2
    assert got[AUDIO]["pct_with_movement"] == 100.0
    with pytest.raises(ValueError):
        stock_flow_report(micro_listings, micro_facts, SCOPE, FlowRules(unit="row"))


@pytest.mark.parametrize("scope", [SCOPE, SKEWED])
def test_draft_keeps_listings_without_observations(micro_listings, micro_facts, scope):
    got = by(stock_flow_draft_report(micro_listings, micro_facts, scope))
    assert got[AUDIO]["total_products"] == 3
    assert got[AUDIO]["products_with_movement"] == 2
    assert got[AUDIO]["total_stock"] == 33.0
    assert got[AUDIO]["revenue"] == pytest.approx(339.99)
    assert got[AUDIO]["units_sold"] == 3.0
    assert got[TABLETS]["units_sold"] == 3.0
    # The unreadable quantity stays unknown: 5, 2, unknown, 2.
    assert got[TABLETS]["total_stock"] == 9.0
    assert got[TABLETS]["products_with_movement"] == 1


def test_strict_quantity_stops(micro_listings, micro_facts):
    rules = FlowRules(strict_quantity=True, fill="keep")
    with pytest.raises(Exception, match="not a number: n/a"):
        stock_flow_draft_report(micro_listings, micro_facts, SCOPE, rules).collect()


@pytest.mark.parametrize("scope", [SCOPE, SKEWED])
def test_ancestors(spark, micro_listings, micro_facts, scope):
    got = by(stock_flow_by_ancestor(micro_listings, micro_facts, scope))
    assert set(got) == {"Electrónica", "Audio", "Computación", "Tablets"}
    assert got["Audio"]["total_products"] == got["Electrónica"]["total_products"] == 2
    # An unreadable quantity is taken as 0 here: 5, 2, 0, 2.
    assert got["Tablets"]["products_with_movement"] == 3
    assert got["Tablets"]["products_with_sales"] == 2
    assert got["Tablets"]["units_sold"] == 5.0
    assert got["Tablets"]["observations_in_stock"] == 3


def test_name_twice_in_one_path_counts_rows_twice_but_the_product_once(spark, micro_facts):
    listings = spark.createDataFrame(
        [("u1", '[{"name":"A"},{"name":"B"},{"name":"A"}]')], "url string, breadcrumbs string"
    )
    got = by(stock_flow_by_ancestor(listings, micro_facts, replace(SCOPE, targets=None)))
    assert got["A"]["total_products"] == got["B"]["total_products"] == 1
    assert got["A"]["products_with_sales"] == 2 * got["B"]["products_with_sales"] == 2
    assert got["A"]["total_stock"] == 2 * got["B"]["total_stock"] == 58.0


def test_prices(micro_listings, micro_facts):
    got = by(price_report(micro_listings, micro_facts, SCOPE))
    assert got[AUDIO]["min_price"] == 9.99
    assert got[AUDIO]["max_price"] == 120.0
    assert got[AUDIO]["avg_price"] == pytest.approx(84.9975)
    assert got[AUDIO]["median_price"] == 105.0
    assert tuple(got[TABLETS].values()) == (TABLETS, 50.0, 60.0, 55.0, 55.0)
    last = by(price_report(micro_listings, micro_facts, SCOPE, level="last"))
    assert set(last) == {"audio", "tablets"}


def test_look_back_and_report_date(micro_listings, micro_facts):
    scope = replace(SCOPE, as_of=date(2024, 2, 2), lookback_days=30)
    got = by(stock_flow_report(micro_listings, micro_facts, scope))
    assert got[AUDIO]["total_products"] == 2  # from 2024-01-03 on: u1 and u3
    assert got[AUDIO]["products_with_sales"] == 0
    assert got[AUDIO]["total_stock"] is None


def test_targets_match_in_any_case_unless_told_not_to(spark, micro_listings, micro_facts):
    loud = replace(SCOPE, targets=("ELECTRÓNICA",))
    assert set(by(stock_flow_report(micro_listings, micro_facts, loud))) == {AUDIO}
    exact = replace(loud, match_case=True)
    assert by(stock_flow_report(micro_listings, micro_facts, exact)) == {}
    every = replace(SCOPE, targets=None)
    assert "hogar" in by(stock_flow_report(micro_listings, micro_facts, every))
    assert len(DEFAULT_TARGETS) == 5


def test_nothing_matches_gives_an_empty_report_of_the_same_columns(micro_listings, micro_facts):
    nothing = replace(SCOPE, targets=("zzz",))
    for build in (stock_flow_report, stock_flow_draft_report, price_report):
        empty = build(micro_listings, micro_facts, nothing)
        assert empty.columns == build(micro_listings, micro_facts, SCOPE).columns
        assert empty.count() == 0


def test_listing_snapshots_are_reduced_to_the_newest(spark, micro_facts):
    listings = spark.createDataFrame(
        [
            ("u1", '[{"name":"Old"}]', datetime(2023, 1, 1)),
            ("u1", '[{"name":"New"}]', datetime(2023, 6, 1)),
        ],
        "url string, breadcrumbs string, created timestamp_ntz",
    )
    scope = replace(SCOPE, targets=None, one_row_per_listing=False)
    assert set(by(stock_flow_report(listings, micro_facts, scope))) == {"new"}


@pytest.fixture(scope="module")
def shop(spark):
    breadcrumbs = '[{"name":"Electrónica"},{"name":"Audio"}]'
    listings = spark.createDataFrame(
        [
            ("a", breadcrumbs, '[{"name":"X"},{"name":"Y"}]', 1),
            ("b", breadcrumbs, '{"name":"X"}', 2),
            ("c", breadcrumbs, '[{"name":"Z"}]', 2),
            ("d", breadcrumbs, "[]", 3),
            ("e", breadcrumbs, None, 1),
            ("f", '[{"name":"Electrónica"}]', '[{"name":"Q"}]', 1),
            ("g", breadcrumbs, '[{"name":"W"}]', 9),
            ("h", breadcrumbs, '[{"name":"V"}]', 1),
        ],
        "url string, breadcrumbs string, brand string, seller_id long",
    )
    steps = {"a": [5, 3], "b": [1, 4], "c": [2, 2], "d": [9, 1], "e": [9, 1], "f": [1, 1], "g": [8, 1]}
    rows = [
        (url, datetime(2024, 1, day + 1), day, str(quantity), f"{10 * day + 5}.5")
        for url, quantities in steps.items()
        for day, quantity in enumerate(quantities)
    ]
    facts = spark.createDataFrame(
        rows,
        "url_id string, created timestamp_ntz, id long, available_quantity string, price string",
    )
    sellers = spark.createDataFrame(
        [(n, f"s{n}", datetime(2023, 1, 1 + k)) for n in (1, 2, 3) for k in range(n)],
        "seller_id long, seller_name string, created timestamp_ntz",
    )
    return listings, facts, sellers


@pytest.mark.parametrize("scope", [SCOPE, SKEWED])
def test_brands_and_sellers(shop, scope):
    listings, facts, sellers = shop
    got = by(brand_seller_report(listings, facts, sellers, scope), "categories")
    # Brands X, Y (sold through a), Z; W's seller is unknown, V has no observations.
    assert got["Electrónica,Audio"] == {
        "categories": "Electrónica,Audio",
        "brands_with_sales": 2,
        "total_brands": 3,
        "pct_brands_with_sales": pytest.approx(200 / 3),
        "sellers_count": 2,
        "sellers_with_sales_count": 1,
        "pct_sellers_with_sales": 50.0,
    }
    # No seller with a sale: missing, not 0.
    assert got["Electrónica"]["sellers_with_sales_count"] is None
    assert got["Electrónica"]["pct_sellers_with_sales"] is None
    assert got["Electrónica"]["brands_with_sales"] == 0


@pytest.mark.parametrize("scope", [SCOPE, SKEWED])
def test_raw_brands(shop, scope):
    listings, facts, _ = shop
    got = by(raw_brand_report(listings, facts, replace(scope, targets=None)))
    # The raw texts: the list of X and Y, the object X, Z, [], W, V; NULL is no brand.
    assert got["Electrónica,Audio"]["total_brands"] == 6
    assert got["Electrónica,Audio"]["brands_with_sales"] == 3
    assert got["Electrónica,Audio"]["pct_brands_with_sales"] == 50.0


@pytest.mark.parametrize("scope", [SCOPE, SKEWED])
def test_seller_prices(shop, scope):
    listings, facts, _ = shop
    got = by(seller_price_report(listings, facts, replace(scope, targets=None)))
    audio = got["Audio"]
    assert (audio["total_sellers"], audio["sellers_with_sales"]) == (4, 3)
    assert audio["pct_sellers_with_sales"] == 75.0
    # Every listing ends at 15.5, so the lowest latest price is above the lowest price.
    assert (audio["min_price"], audio["max_price"]) == (15.5, 15.5)
    assert (audio["avg_price"], audio["median_price"]) == (10.5, 10.5)
    assert got["Electrónica"]["total_sellers"] == 4


def test_both_ways_to_the_price_report_by_product(spark, micro_listings, micro_facts):
    listings = micro_listings.withColumn("product_id", F.concat(F.lit("p"), "url"))
    start, end = date(2024, 1, 1), date(2024, 1, 3)
    got = price_report_by_product(listings, micro_facts, start, end)
    # The other way: filter and join by hand, then the built-in statistics.
    joined = listings.join(
        micro_facts.where((F.col("created") >= F.lit(start)) & (F.col("created") <= F.lit(end))),
        F.col("url") == F.col("url_id"),
    ).withColumn("price", F.col("price").try_cast("double"))
    want = joined.groupBy("product_id", F.col("breadcrumbs").alias("category")).agg(
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.avg("price").alias("mean_price"),
        F.median("price").alias("median_price"),
    )
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("first_counts", [False, True])
def test_changed_products(spark, first_counts):
    listings = spark.createDataFrame(
        [("a", ["X", "Y"]), ("b", ["X"]), ("c", []), ("d", None), ("e", ["Y"])],
        "url string, breadcrumbs array<string>",
    )
    facts = spark.createDataFrame(
        [("a", 1, 5.0), ("a", 2, 4.0), ("b", 1, 3.0), ("b", 2, 3.0), ("c", 1, 1.0), ("c", 2, 9.0)],
        "url_id string, created int, available_quantity double",
    ).withColumn("created", F.timestamp_seconds("created").cast("timestamp_ntz"))
    scope = Scope(targets=None, skew=EAGER)
    got = by(changed_products_report(listings, facts, scope, first_counts))
    assert got["X"] == {
        "category": "X",
        "count_of_products": 2,
        "changed_products": 2 if first_counts else 1,
    }
    assert got["Y"]["count_of_products"] == 1
    assert set(got) == {"X", "Y"}


def test_filtered_extract(micro_listings, micro_facts):
    got = filtered_extract(micro_listings, micro_facts, date(2024, 1, 1), date(2024, 1, 3), SCOPE)
    rows = {(r["url"], r["available_quantity"], r["last_category"]) for r in got.collect()}
    assert rows == {
        ("u1", 10.0, "audio"),
        ("u1", 7.0, "audio"),
        ("u2", 5.0, "tablets"),
        ("u2", 2.0, "tablets"),
    }


def test_product_history(spark, micro_listings, micro_facts):
    listings = micro_listings.withColumn("product_id", F.lit("p"))
    facts = micro_facts.withColumn("product_id", F.lit("p"))
    got = product_history(
        listings, facts, "p", date(2024, 1, 2), datetime(2024, 1, 3, 8), policy=EAGER
    )
    rows = [(r["url"], r["available_quantity"]) for r in got.collect()]
    assert rows == [
        ("u1", "12"), ("u1", "7"), ("u2", "n/a"), ("u2", "2"),
        ("u3", None), ("u4", None), ("u5", "1"), ("u6", None),
    ]


@pytest.mark.parametrize("parts", [1, 5])
def test_order_and_partitions_of_the_input_do_not_matter(micro_listings, micro_facts, parts):
    want = rows_of(stock_flow_report(micro_listings, micro_facts, SCOPE))
    mixed = micro_facts.orderBy(F.desc("price")).repartition(parts, "price")
    assert rows_of(stock_flow_report(micro_listings, mixed, SCOPE)) == want
    assert rows_of(stock_flow_report(micro_listings, mixed, SKEWED)) == want


def test_changes_add_up_to_last_minus_first(micro_listings, micro_facts):
    wanted = micro_listings.select("url")
    totals = by(listing_totals(wanted, micro_facts, SKEWED, FlowRules()), "url")
    assert totals["u1"]["units"] == -3.0
    assert totals["u1"]["stock"] == 29.0
    assert totals["u2"]["sales"] == 1
