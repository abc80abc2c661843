"""Stock movement, sales, revenue and stock per category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.expand import per_distinct_element
from vitrine.operators.filters import drop_missing
from vitrine.operators.measures import any_by, coverage, stock_flow_by
from vitrine.operators.panel import change, is_movement, with_previous
from vitrine.plans.config import Scope
from vitrine.plans.histories import (
    DRAFT_RULES,
    FINAL_RULES,
    ZERO_RULES,
    FlowRules,
    listing_totals,
)
from vitrine.plans.inputs import categories_of_listings, target_listings


def stock_flow_report(
    listings: DataFrame, observations: DataFrame, scope: Scope, rules: FlowRules = FINAL_RULES
) -> DataFrame:
    """The stock-flow report per category path. Needs ``scope.as_of``."""
    per_listing = listing_totals(target_listings(listings, scope), observations, scope, rules)
    return stock_flow_by(per_listing, ["category"], rules.unit).select(
        "category",
        "total_products",
        "products_with_movement",
        "products_with_sales",
        "pct_with_movement",
        "pct_with_sales",
        "products_with_available_quantity",
        "revenue",
        F.col("stock_today").alias("total_stock"),
    )


def stock_flow_draft_report(
    listings: DataFrame, observations: DataFrame, scope: Scope, rules: FlowRules = DRAFT_RULES
) -> DataFrame:
    """Earlier form: stock over all observations, revenue as the plain sum of prices."""
    per_listing = listing_totals(target_listings(listings, scope), observations, scope, rules)
    return stock_flow_by(per_listing, ["category"], rules.unit).select(
        "category",
        "total_products",
        "products_with_movement",
        "products_with_sales",
        F.col("stock").alias("total_stock"),
        "pct_with_movement",
        "pct_with_sales",
        "products_with_available_quantity",
        F.col("price_sum").alias("revenue"),
        "units_sold",
    )


def stock_flow_by_ancestor(
    listings: DataFrame, observations: DataFrame, scope: Scope, rules: FlowRules = ZERO_RULES
) -> DataFrame:
    """Stock flow of every category a listing is under, not only its full path.

    Listings are reduced to one row each before they are spread over their categories.
    """
    wanted = target_listings(listings, scope).select("url")
    per_listing = listing_totals(wanted, observations, scope, rules)
    # Joined only now, so that the facts do not carry lists of categories through the shuffle.
    spread = categories_of_listings(listings, scope).join(per_listing, "url")
    return stock_flow_by(spread, ["category"], rules.unit, times="times").select(
        "category",
        "total_products",
        "products_with_movement",
        "products_with_sales",
        "pct_with_movement",
        "pct_with_sales",
        "observations_in_stock",
        F.col("stock").alias("total_stock"),
        F.col("price_sum").alias("revenue"),
        "units_sold",
    )


def changed_products_report(
    listings: DataFrame, observations: DataFrame, scope: Scope, first_counts: bool = False
) -> DataFrame:
    """Products and products whose stock ever changed, per category.

    ``listings`` holds url and the list column ``breadcrumbs``; ``observations`` holds url_id,
    created and a number ``available_quantity``.
    """
    steps = with_previous(
        drop_missing(observations, "url_id"),
        ["url_id"],
        "created",
        scope.tiebreak,
        {"quantity_before": "available_quantity"},
        policy=scope.skew,
        null_keys=False,
    )
    moved = is_movement(
        change(F.col("available_quantity"), F.col("quantity_before")), first_counts
    )
    changed = any_by(steps, ["url_id"], moved, "changed")
    rows = per_distinct_element(
        listings.join(changed, F.col("url") == F.col("url_id")).select("url", "breadcrumbs", "changed"),
        "breadcrumbs",
        "category",
        "times",
    )
    per_product = any_by(rows, ["category", "url"], F.col("changed"), "changed")
    return coverage(
        per_product, ["category"], "changed", "count_of_products", "changed_products", "pct_changed"
    ).drop("pct_changed")
