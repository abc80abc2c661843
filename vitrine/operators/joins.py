"""Joins of the three catalogue tables.

No side is broadcast by hand: Spark picks a broadcast itself when the measured size allows it.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.filters import since
from vitrine.operators.skew import DEFAULT_POLICY, SLICE, SkewPolicy, join_facts, plan_spread


def listings_with_facts(
    listings: DataFrame,
    facts: DataFrame,
    how: str = "left",
    on: tuple[str, str] = ("url", "url_id"),
    policy: SkewPolicy = DEFAULT_POLICY,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join listings with observations; a listing with very many observations is spread.

    No column may have the same name on both sides.
    hot: the listings with very many observations (key, _rows), if known (storage.hot_keys); then no
        job runs while the plan is built.
    """
    if how == "inner":
        return listings.join(facts, F.col(on[0]) == F.col(on[1]), "inner")
    slices = plan_spread(facts, on[1], policy, hot)
    return join_facts(listings, facts, on, how, slices).drop(SLICE)


def listings_with_recent_facts(
    listings: DataFrame,
    facts: DataFrame,
    as_of: date,
    days: int,
    how: str = "left",
    policy: SkewPolicy = DEFAULT_POLICY,
    hot: DataFrame | None = None,
) -> DataFrame:
    """The same with the date bound as part of the join: listings without recent rows stay."""
    recent = facts.where(since(F.col("created"), as_of, days))
    return listings_with_facts(listings, recent, how, policy=policy, hot=hot)


def latest_per_key(
    rows: DataFrame, key: str, time: str, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """Newest row of each key. Combines before the shuffle, so a hot key is no burden."""
    rest = [name for name in rows.columns if name != key]
    newest = F.max_by(F.struct(*rest), F.struct(time, *tiebreak))
    return (
        rows.where(F.col(key).isNotNull()).groupBy(key).agg(newest.alias("_row")).select(key, "_row.*")
    )


def with_dimension(rows: DataFrame, dimension: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Attach a dimension that is unique by key. A hot key is split on the rows' side."""
    return rows.join(dimension, key, how)


def assemble(parts: Sequence[DataFrame], key: str, how: str) -> DataFrame:
    """Join tables that hold one row per category."""
    whole, *others = parts
    for part in others:
        whole = whole.join(part, key, how)
    return whole
