"""Counts per category, by way of one row per listing.

Every count of different products, sellers or brands is taken over rows that are already unique
per (category, thing). That needs no distinct aggregate, and the wide rows of the fact table
are reduced to one row per listing before any category, hot or not, is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.numbers import exact_sum, percent
from vitrine.operators.filters import drop_missing, on_day
from vitrine.operators.panel import is_movement, is_sale, step_revenue_doubled


def count_distinct_by(
    rows: DataFrame, keys: Sequence[str], thing: str, new: str, when: Column | None = None
) -> DataFrame:
    """Different things per key; with ``when``, those with at least one such row.

    Keys and things that are NULL are not counted. A key without any hit has 0.
    """
    hit = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
    pairs = drop_missing(rows, *keys).groupBy(*keys, thing).agg(F.bool_or(hit).alias("_hit"))
    return pairs.groupBy(*keys).agg(
        F.count_if(F.col("_hit") & F.col(thing).isNotNull()).alias(new)
    )


def any_by(rows: DataFrame, keys: Sequence[str], flag: Column, new: str) -> DataFrame:
    """Whether any row of the group has the flag. Groups with a NULL key are left out."""
    return drop_missing(rows, *keys).groupBy(*keys).agg(
        F.bool_or(F.coalesce(flag, F.lit(False))).alias(new)
    )


def coverage(
    flagged: DataFrame, keys: Sequence[str], flag: str, total: str, hits: str, share: str
) -> DataFrame:
    """Over rows that are unique members of a key: members, flagged members, percent."""
    return flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(total), F.count_if(flag).alias(hits)
    ).withColumn(share, percent(F.col(hits), F.col(total)))


def stock_steps_per_listing(
    rows: DataFrame,
    keys: Sequence[str],
    today: date | None,
    first_counts: bool,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """What one listing did, from its rows with quantity, change, price and price_before."""
    change, quantity, price = F.col("stock_change"), F.col("quantity"), F.col("price")
    is_today = F.lit(False) if today is None else on_day(F.col("created"), today)
    doubled = step_revenue_doubled(F.col("price_before"), price, change)
    return rows.groupBy(*keys).agg(
        F.count_if(is_movement(change, first_counts)).alias("movements"),
        F.count_if(is_sale(change)).alias("sales"),
        F.count_if(quantity > 0).alias("stocked"),
        exact_sum(quantity).alias("stock"),
        exact_sum(F.when(is_today, quantity)).alias("stock_today"),
        exact_sum(doubled).alias("revenue_doubled"),
        exact_sum(price).alias("price_sum"),
        exact_sum(F.least(change, F.lit(0.0))).alias("units"),
        F.max(F.struct("created", *tiebreak, "price")).alias("latest"),
    )


def merge_listing_slices(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add up the slices of one listing."""
    counts = [F.sum(name).alias(name) for name in ("movements", "sales", "stocked")]
    sums = [
        exact_sum(F.col(name)).alias(name)
        for name in ("stock", "stock_today", "revenue_doubled", "price_sum", "units")
    ]
    return parts.groupBy(*keys).agg(*counts, *sums, F.max("latest").alias("latest"))


def stock_flow_by(
    listings: DataFrame, keys: Sequence[str], unit: str = "event", times: str | None = None
) -> DataFrame:
    """Category totals from one row per (category, listing).

    unit: "event" counts observations, "product" counts listings that have any.
    times: column telling how often the listing is in the category.
    """
    if unit not in ("event", "product"):
        raise ValueError(f"unit must be event or product, not {unit}")
    weight = F.lit(1) if times is None else F.col(times)

    def happened(name: str) -> Column:
        return F.count_if(F.col(name) > 0) if unit == "product" else F.sum(F.col(name) * weight)

    def total(name: str) -> Column:
        return exact_sum(F.col(name) * weight)

    return (
        drop_missing(listings, *keys)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("total_products"),
            happened("movements").alias("products_with_movement"),
            happened("sales").alias("products_with_sales"),
            F.count_if(F.col("stocked") > 0).alias("products_with_available_quantity"),
            F.sum(F.col("stocked") * weight).alias("observations_in_stock"),
            F.greatest(
                F.coalesce(total("revenue_doubled"), F.lit(0.0)) / 2, F.lit(0.0)
            ).alias("revenue"),
            F.coalesce(total("price_sum"), F.lit(0.0)).alias("price_sum"),
            F.coalesce(total("stock"), F.lit(0.0)).alias("stock"),
            total("stock_today").alias("stock_today"),
            F.abs(F.coalesce(total("units"), F.lit(0.0))).alias("units_sold"),
        )
        .withColumn(
            "pct_with_movement", percent(F.col("products_with_movement"), F.col("total_products"))
        )
        .withColumn("pct_with_sales", percent(F.col("products_with_sales"), F.col("total_products")))
    )
