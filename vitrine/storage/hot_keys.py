"""Which keys hold very many rows, from a summary kept beside the table.

For each day there is a sketch of the most frequent keys (frequent items, which takes a fixed number
of counters). Sketches of any days can be merged, so a look-back is answered from its days alone, and
a new day adds one row. Nothing of the table itself is read while a plan is built.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.skew import SkewPolicy

#: Counters of a sketch. A count is off by at most ERROR / TRACKED of all rows summarized.
TRACKED, ERROR = 16_384, 4


def summarize(rows: DataFrame, key: str, time: str, tracked: int = TRACKED) -> DataFrame:
    """(day, rows, sketch): one row for each day, whatever the number of keys. NULL keys don't count."""
    sketch = F.expr(f"approx_top_k_accumulate(`{key}`, {int(tracked)})")
    known = rows.where(F.col(key).isNotNull()).select(key, F.to_date(time).alias("day"))
    return known.groupBy("day").agg(F.count(F.lit(1)).alias("rows"), sketch.alias("sketch"))


def frequent_keys(
    summary: DataFrame,
    key: str,
    at_least: int,
    since: date | None = None,
    until: date | None = None,
    tracked: int = TRACKED,
) -> DataFrame:
    """(key, _rows): the keys with at least so many rows in the days [since, until).

    No key that reaches the bar is left out: those that may reach it, given the error of the
    sketches, are in too. That error is ERROR / tracked of the rows of the days that are merged.
    """
    wanted = _within(F.col("day"), since, until)
    # Grouped, as no day at all has no sketch to merge.
    merged = summary.where(wanted).groupBy(F.lit(0).alias("all")).agg(
        F.sum("rows").alias("rows"),
        F.expr(f"approx_top_k_combine(sketch, {int(tracked)})").alias("sketch"),
    )
    counted = merged.select(
        "rows", F.explode(F.expr(f"approx_top_k_estimate(sketch, {int(tracked)})")).alias("found")
    )
    most = F.col("found.count") + F.col("rows") * ERROR / tracked
    return counted.where(most >= at_least).select(
        F.col("found.item").alias(key), F.col("found.count").cast("double").alias("_rows")
    )


def _within(day: Column, since: date | None, until: date | None) -> Column:
    wanted = F.lit(True)
    if since is not None:
        wanted = wanted & (day >= F.lit(since))
    if until is not None:
        wanted = wanted & (day < F.lit(until))
    return wanted


def hot_from_summary(
    summary: DataFrame,
    key: str,
    policy: SkewPolicy,
    since: date | None = None,
    until: date | None = None,
    tracked: int = TRACKED,
) -> DataFrame:
    """The keys too large for one task, as joins and slices take them (``hot``)."""
    return frequent_keys(summary, key, policy.min_rows, since, until, tracked)
