"""The cleaned inputs every report starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.names import breadcrumb_names, breadcrumb_path, last_name, strip
from vitrine.functions.numbers import or_zero, to_number, to_number_strict
from vitrine.operators.expand import per_distinct_element
from vitrine.operators.filters import drop_missing, in_any_category, since
from vitrine.operators.joins import latest_per_key
from vitrine.operators.skew import SLICE, Slices, plan_slices
from vitrine.plans.config import Scope


def category_of(breadcrumbs: Column, level: str) -> Column:
    """Category text of a listing: lower-cased path, path as written, last name, or raw JSON."""
    if level == "path":
        return breadcrumb_path(breadcrumbs)
    if level == "path_cased":
        return breadcrumb_path(breadcrumbs, lower=False)
    if level == "last":
        return strip(F.lower(last_name(breadcrumb_names(breadcrumbs))))
    if level == "raw":
        return breadcrumbs
    raise ValueError(f"no such category level: {level}")


def target_listings(
    listings: DataFrame, scope: Scope, level: str = "path", keep: tuple[str, ...] = ()
) -> DataFrame:
    """url and category of the listings in a target category, plus the columns to keep.

    Listings without a readable category are left out.
    """
    if not scope.one_row_per_listing:
        time = "created" if "created" in listings.columns else "url"
        rest = [name for name in listings.columns if name not in ("url", time)]
        listings = latest_per_key(listings, "url", time, rest)
    if scope.targets is not None:
        # Matched on the whole path, whatever level is reported.
        path = breadcrumb_path(F.col("breadcrumbs"), lower=False)
        listings = listings.where(in_any_category(path, scope.targets, scope.match_case))
    wanted = listings.select(
        "url", category_of(F.col("breadcrumbs"), level).alias("category"), *keep
    )
    # A match on the path has left out unreadable paths already.
    return drop_missing(wanted, "category") if scope.targets is None else wanted


def categories_of_listings(listings: DataFrame, scope: Scope, *keep: str) -> DataFrame:
    """One row per listing and different ancestor category, with how often it is named."""
    names = breadcrumb_names(F.col("breadcrumbs")).alias("names")
    wanted = target_listings(listings, scope, "raw", keep=(*keep, names)).drop("category")
    return per_distinct_element(wanted, "names", "category", "times")


def recent(observations: DataFrame, scope: Scope) -> DataFrame:
    if scope.as_of is None:
        return observations
    return observations.where(since(F.col("created"), scope.as_of, scope.lookback_days))


def clean_facts(
    observations: DataFrame,
    scope: Scope,
    fill: str | None = None,
    strict_quantity: bool = False,
    keep_price: bool = True,
) -> DataFrame:
    """url_id, quantity, price, created and the tie-break columns of the observations in scope.

    fill: None drops rows whose quantity is no number, "zero" takes them as 0, "keep" keeps
        them as NULL. Stored rows keep the number of their slice.
    """
    number = to_number_strict if strict_quantity else to_number
    quantity = number(F.col("available_quantity"))
    if fill == "zero":
        quantity = or_zero(quantity)
    rows = recent(observations, scope).select(
        "url_id",
        quantity.alias("quantity"),
        *([to_number(F.col("price")).alias("price")] if keep_price else []),
        "created",
        *scope.tiebreak,
        *([SLICE] if SLICE in observations.columns else []),
    )
    return drop_missing(rows, "quantity") if fill is None else rows


def listing_slices(observations: DataFrame, scope: Scope) -> Slices:
    """Slices of listings that are hot among the observations in scope.

    Found once, they serve all reports over the same observations: see Scope.slices.
    """
    if scope.slices is not None:
        return scope.slices
    if not scope.skew.enabled:
        return Slices(("url_id",), "created", scope.tiebreak)
    facts = recent(observations, scope).select("url_id", "created", *scope.tiebreak)
    return plan_slices(facts, ["url_id"], "created", scope.skew, scope.tiebreak)
