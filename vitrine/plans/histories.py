"""What every listing did: observations joined with listings, stepped through in time order."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.measures import merge_listing_slices, stock_steps_per_listing
from vitrine.operators.panel import change, with_previous
from vitrine.operators.skew import SLICE, join_facts
from vitrine.plans.config import Scope
from vitrine.plans.inputs import clean_facts, listing_slices


@dataclass(frozen=True)
class FlowRules:
    """How steps are counted.

    first_counts: the first observation of a listing is a movement.
    unit: "event" counts observations, "product" counts listings.
    fill: what becomes of a quantity that is no number: None drops the row, "zero" takes 0,
        "keep" leaves it unknown.
    unmatched: listings without observations are reported too.
    strict_quantity: a quantity that is no number stops the job.
    """

    first_counts: bool = True
    unit: str = "event"
    fill: str | None = None
    unmatched: bool = False
    strict_quantity: bool = False


FINAL_RULES = FlowRules()
DRAFT_RULES = FlowRules(first_counts=False, fill="keep", unmatched=True)
ZERO_RULES = FlowRules(first_counts=False, fill="zero")


def listing_steps(
    wanted: DataFrame, observations: DataFrame, scope: Scope, rules: FlowRules
) -> DataFrame:
    """Observations of the wanted listings with price and stock change of each step.

    Join and window use the same keys, so the facts are shuffled once for both.
    """

    def clean(rows: DataFrame) -> DataFrame:
        return clean_facts(rows, scope, rules.fill, rules.strict_quantity)

    slices = listing_slices(observations, scope)
    joined = join_facts(
        wanted,
        clean(observations),
        ("url", "url_id"),
        "left" if rules.unmatched else "inner",
        slices,
    )
    # Only the rows of hot listings are cleaned a second time.
    history = clean(slices.only_hot(observations)) if slices.any else None
    return with_previous(
        joined,
        ["url"],
        "created",
        scope.tiebreak,
        {"quantity_before": "quantity", "price_before": "price"},
        slices=slices.on_key("url"),
        history=history.withColumnRenamed("url_id", "url") if history else None,
        null_keys=False,
    ).withColumn("stock_change", change(F.col("quantity"), F.col("quantity_before")))


def listing_totals(
    wanted: DataFrame,
    observations: DataFrame,
    scope: Scope,
    rules: FlowRules,
    today: date | None = None,
) -> DataFrame:
    """One row per listing with the columns of ``wanted`` and what the listing did.

    today: the day whose stock is added up, the report date unless given.
    """
    today = today or scope.as_of
    steps = listing_steps(wanted.where(F.col("url").isNotNull()), observations, scope, rules)
    keys = list(wanted.columns)
    sliced = SLICE in steps.columns
    parts = stock_steps_per_listing(
        steps, [*keys, SLICE] if sliced else keys, today, rules.first_counts, scope.tiebreak
    )
    return merge_listing_slices(parts, keys) if sliced else parts
