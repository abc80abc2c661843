"""Row extracts."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.names import breadcrumb_names, breadcrumb_path, last_name, strip
from vitrine.functions.numbers import to_number
from vitrine.operators.filters import between, drop_missing, in_any_category
from vitrine.operators.joins import listings_with_facts
from vitrine.operators.ordering import by_listing_newest_first, sweep_days
from vitrine.operators.skew import DEFAULT_POLICY, SkewPolicy
from vitrine.plans.config import Scope


def filtered_extract(
    listings: DataFrame, observations: DataFrame, start: date, end: date, scope: Scope
) -> DataFrame:
    """Cleaned observations of the target listings in the days ``[start, end)``."""
    facts = drop_missing(
        sweep_days(observations, "created", start, end).select(
            "url_id",
            to_number(F.col("available_quantity")).alias("available_quantity"),
            to_number(F.col("price")).alias("price"),
            F.col("created").alias("product_created"),
            "snapshot_date",
        ),
        "available_quantity",
    )
    names = breadcrumb_names(F.col("breadcrumbs"))
    wanted = listings.select(
        "url",
        breadcrumb_path(F.col("breadcrumbs")).alias("categories"),
        strip(F.lower(last_name(names))).alias("last_category"),
    )
    if scope.targets is not None:
        wanted = wanted.where(
            in_any_category(F.col("categories"), scope.targets, scope.match_case)
        )
    return wanted.join(facts, F.col("url") == F.col("url_id")).drop("url_id")


def product_history(
    listings: DataFrame,
    observations: DataFrame,
    product_id: str,
    start: date | datetime,
    end: date | datetime,
    policy: SkewPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """All observations of one product in a closed range, newest first per listing.

    A listing of the product without observations stays, with NULLs.
    """
    wanted = listings.where(F.col("product_id") == product_id).select("url", "breadcrumbs")
    facts = observations.where(
        (F.col("product_id") == product_id) & between(F.col("created"), start, end)
    ).select("url_id", "available_quantity", "price", "created")
    joined = listings_with_facts(wanted, facts, "left", policy=policy)
    return by_listing_newest_first(
        joined.select(
            "url", "breadcrumbs", "available_quantity", "price", F.col("created").alias("product_created")
        ),
        "url",
        "product_created",
    )
