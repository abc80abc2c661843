"""Price statistics per category."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.numbers import to_number
from vitrine.operators.filters import between
from vitrine.operators.skew import DEFAULT_POLICY, SkewPolicy, hot_keys
from vitrine.operators.stats import price_stats, price_stats_in_place
from vitrine.plans.config import Scope
from vitrine.plans.inputs import clean_facts, target_listings
from vitrine.session import written


def price_report(
    listings: DataFrame, observations: DataFrame, scope: Scope, level: str = "path"
) -> DataFrame:
    """Minimum, maximum, mean and median price per category, over priced observations.

    Rows whose quantity is no number are left out, so listings without observations are too
    and the join is an inner one. A hot listing is split by adaptive execution.
    """
    facts = clean_facts(observations, scope).select("url_id", "price")
    rows = target_listings(listings, scope, level).join(facts, F.col("url") == F.col("url_id"))
    return price_stats(rows, ["category"])


def price_report_by_product(
    listings: DataFrame,
    observations: DataFrame,
    start: date | datetime,
    end: date | datetime,
    policy: SkewPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """The same per product and raw breadcrumb text, over a closed range of time.

    Products have few observations each, so rows are shuffled by listing for the join and by
    product for all the rest. Products with very many are told apart by a sample first, and go the
    way of categories, which spreads them by price.
    """
    facts = observations.where(between(F.col("created"), start, end)).select(
        "url_id", to_number(F.col("price")).alias("price")
    )
    listed = listings.select("url", "product_id", F.col("breadcrumbs").alias("category"))

    def joined(some: DataFrame) -> DataFrame:
        return listed.join(some, F.col("url") == F.col("url_id"))

    names = ("min_price", "max_price", "mean_price", "median_price")
    keys = ["product_id", "category"]
    rows = joined(facts)
    if not policy.enabled:
        return price_stats_in_place(rows, keys, "price", names, by="product_id")
    sample = joined(policy.thin(facts.select("url_id"))).where(F.col("product_id").isNotNull())
    hot = written(hot_keys(sample, ["product_id"], policy).select("product_id"))
    if hot.isEmpty():
        return price_stats_in_place(rows, keys, "price", names, by="product_id")
    small = rows.join(hot, "product_id", "left_anti")
    large = rows.join(hot, "product_id", "left_semi")
    return price_stats_in_place(small, keys, "price", names, by="product_id").unionByName(
        price_stats(large, keys, names=names)
    )
