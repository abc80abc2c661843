"""Price statistics per group, with an exact median that no single task has to hold.

The built-in median keeps every different value of a group in one task's memory. Here the
values are first counted (group, value), which combines before the shuffle and spreads a hot
group by value. The median is then found by rank: a coarse histogram of the group says in which
cell the middle rank lies, and only that cell's values are put in order.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.numbers import exact_sum
from vitrine.operators.filters import drop_missing
from vitrine.session import written

# Aggregates by name: the function and its column.
More = Mapping[str, tuple[Callable[[str], Column], str]]

# Cells per doubling of the value: prices between a cent and ten million fall into some eight
# thousand cells, so a cell holds a tiny part of even the largest group.
_CELLS_PER_OCTAVE = 256
_CELL_LIMIT = _CELLS_PER_OCTAVE * 1100


def value_counts(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str | None = None,
    more: More | None = None,
) -> DataFrame:
    """Rows per (key, value), and further aggregates. Groups with a NULL key are left out."""
    count = F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0))
    rest = [merge(column).alias(new) for new, (merge, column) in (more or {}).items()]
    return drop_missing(rows, *keys).groupBy(*keys, value).agg(count.alias("_n"), *rest)


def _cell(value: Column) -> Column:
    """Cell number: never decreases with the value, and the same value has the same cell."""

    def depth(magnitude: Column) -> Column:
        scaled = F.least(F.log2(magnitude) * _CELLS_PER_OCTAVE, F.lit(float(_CELL_LIMIT)))
        return F.floor(scaled) + 2 * _CELL_LIMIT

    number = value.cast("double")
    cell = F.when(number > 0, depth(number)).when(number < 0, -depth(-number))
    return F.coalesce(cell, F.lit(0).cast("long"))


def price_stats(
    rows: DataFrame,
    keys: Sequence[str],
    value: str = "price",
    weight: str | None = None,
    names: Sequence[str] = ("min_price", "max_price", "avg_price", "median_price"),
    more: More | None = None,
) -> DataFrame:
    """Minimum, maximum, mean and exact median of a number per group, NULLs left out.

    A group whose values are all NULL is reported with NULL statistics.
    weight: column that tells how often a row counts.
    more: ``{new: (aggregate, column)}`` found in the same pass, for aggregates that can be taken
        of their own results (min, max, bool_or).
    """
    counts = value_counts(rows, keys, value, weight, more)
    if more:
        # Both branches below start from the counts, with different columns. Without this each
        # would compute them for itself, from the facts on.
        counts = written(counts)
    merged = [merge(new).alias(new) for new, (merge, _) in (more or {}).items()]
    return stats_of_counts(counts, keys, value, names, merged)


def stats_of_counts(
    counts: DataFrame, keys: Sequence[str], value: str, names: Sequence[str], more: Sequence[Column] = ()
) -> DataFrame:
    """The statistics from rows that say how often (``_n``) a key has a value."""
    low, high, mean, median = names
    totals = counts.groupBy(*keys).agg(
        F.min(value).alias(low),
        F.max(value).alias(high),
        _mean(F.col(value).cast("double"), F.col("_n")).alias(mean),
        *more,
    )
    return totals.join(_medians(counts, keys, value, median), list(keys), "left")


def price_stats_in_place(
    rows: DataFrame, keys: Sequence[str], value: str, names: Sequence[str], by: str
) -> DataFrame:
    """The same for groups that are small: rows are dealt by the key ``by`` once, and all steps
    follow where they are. A group whose ``by`` is hot must go through price_stats."""
    low, high, mean, median = names
    counts = value_counts(rows.repartition(by), keys, value)
    known = F.when(F.col(value).isNotNull(), F.col("_n")).otherwise(0)
    whole = Window.partitionBy(*keys)
    up_to_here = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        counts.withColumn("_known", known)
        .withColumn("_end", F.sum("_known").over(up_to_here))
        .withColumn("_total", F.sum("_known").over(whole))
        .withColumn("_start", F.col("_end") - F.col("_known"))
    )
    lower, upper = _middle_ranks(F.col("_total"))
    return placed.groupBy(*keys).agg(
        F.min(value).alias(low),
        F.max(value).alias(high),
        _mean(F.col(value).cast("double"), F.col("_n")).alias(mean),
        ((_at(lower, value) + _at(upper, value)) / 2).alias(median),
    )


def _at(rank: Column, value: str) -> Column:
    """The value whose rows take up the rank."""
    here = (F.col("_start") <= rank) & (rank < F.col("_end"))
    return F.max(F.when(here, F.col(value))).cast("double")


def _mean(number: Column, times: Column) -> Column:
    """Mean of weighted numbers. It lies between the smallest and the largest of them."""
    mean = F.try_divide(
        exact_sum(number, times), F.sum(F.when(number.isNotNull(), times)).cast("double")
    )
    return F.when(mean.isNotNull(), F.least(F.greatest(mean, F.min(number)), F.max(number)))


def _medians(counts: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    # NULL values stay in with a count of 0. A filter here would reach the scan below, and the
    # counts would be computed again instead of shared with the totals.
    known = F.when(F.col(value).isNotNull(), F.col("_n")).otherwise(0)
    placed = counts.withColumns({"_known": known, "_cell": _cell(F.col(value))})
    # A bounded group: the cells of one key.
    whole = Window.partitionBy(*keys)
    up_to_here = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = (
        placed.groupBy(*keys, "_cell")
        .agg(F.sum("_known").alias("_in_cell"))
        .withColumn("_through", F.sum("_in_cell").over(up_to_here))
        .withColumn("_total", F.sum("_in_cell").over(whole))
        .withColumn("_before", F.col("_through") - F.col("_in_cell"))
    )
    lower, upper = _middle_ranks(F.col("_total"))
    middle = cells.where((F.col("_before") <= upper) & (F.col("_through") > lower))
    # The values of one or two cells per key.
    in_cell = Window.partitionBy(*keys, "_cell").orderBy(value)
    up_to_here = in_cell.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = (
        placed.join(middle.select(*keys, "_cell", "_before", "_total"), [*keys, "_cell"])
        .withColumn("_end", F.col("_before") + F.sum("_known").over(up_to_here))
        .withColumn("_start", F.col("_end") - F.col("_known"))
    )
    return values.groupBy(*keys).agg(((_at(lower, value) + _at(upper, value)) / 2).alias(name))


def _middle_ranks(total: Column) -> tuple[Column, Column]:
    """First and second middle rank, counted from 0; the same one when the total is odd."""
    return F.floor((total - 1) / 2), F.floor(total / 2)
