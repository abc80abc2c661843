"""The history of each listing: what changed since the observation before."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators.skew import DEFAULT_POLICY, SLICE, SkewPolicy, Slices, plan_slices

_HAS_PREVIOUS = "_has_previous"
_CARRY = "_carry"


def with_previous(
    rows: DataFrame,
    keys: Sequence[str],
    time: str,
    tiebreak: Sequence[str],
    previous: Mapping[str, str],
    slices: Slices | None = None,
    history: DataFrame | None = None,
    policy: SkewPolicy = DEFAULT_POLICY,
    null_keys: bool = True,
) -> DataFrame:
    """Add, for each ``{new: column}`` in previous, the column's value one observation earlier.

    ``time`` and ``tiebreak`` together must order the rows of a key completely. A key that is
    NULL in any part has no history: its rows get NULL.

    slices: the layout of ``rows`` if they carry slice numbers already (see skew.join_facts).
    history: the frame to take the last row of each slice from; it must hold the same
        observations of every key in ``rows``. Default is ``rows`` itself.
    null_keys: False says that no key is NULL, as after a join on it; it saves a second scan.
    """
    if slices is None:
        slices = plan_slices(rows, keys, time, policy, tiebreak)
    labelled = SLICE in rows.columns
    if slices.any and not labelled:
        rows = slices.label(rows)
    if null_keys:
        # Rows without a key belong to no history. Parted off, they don't meet in one group, and
        # the window's shuffle is by the key alone, so that a later step by key can use it.
        known = F.lit(True)
        for key in keys:
            known = known & F.col(key).isNotNull()
        found = with_previous(
            rows.where(known), keys, time, tiebreak, previous, slices, history, policy, False
        )
        types = {field.name: field.dataType for field in found.schema}
        unknown = {new: F.lit(None).cast(types[new]) for new in previous}
        if SLICE in found.columns and SLICE not in rows.columns:
            unknown[SLICE] = F.lit(0)
        return found.unionByName(rows.where(~known).withColumns(unknown))
    groups = [F.col(key) for key in keys]
    if slices.any:
        groups.append(F.col(SLICE))
    window = Window.partitionBy(*groups).orderBy(time, *tiebreak)
    lagged = {new: F.lag(column).over(window) for new, column in previous.items()}
    if not slices.any:
        return rows.withColumns(lagged)

    rows = rows.withColumns({**lagged, _HAS_PREVIOUS: F.lag(F.lit(True)).over(window)})
    carry = _last_of_slice_before(
        slices, rows if history is None else history, time, tiebreak, previous
    )
    # A row per slice, joined as its size tells Spark to; the window's shuffle is by the same keys.
    rows = rows.join(carry, [*slices.keys, SLICE], "left")
    first = F.col(_HAS_PREVIOUS).isNull()
    rows = rows.withColumns(
        {new: F.when(first, F.col(_CARRY)[new]).otherwise(F.col(new)) for new in previous}
    )
    return rows.drop(_CARRY, _HAS_PREVIOUS)


def _last_of_slice_before(
    slices: Slices,
    history: DataFrame,
    time: str,
    tiebreak: Sequence[str],
    previous: Mapping[str, str],
) -> DataFrame:
    """Per slice of a hot key, the values of the last observation before the slice."""
    columns = list(dict.fromkeys([*slices.keys, time, *tiebreak, *previous.values()]))
    hot_rows = slices.label(history.select(*columns), only_hot=True)
    values = F.struct(*[F.col(column).alias(new) for new, column in previous.items()])
    last = hot_rows.groupBy(*slices.keys, SLICE).agg(
        F.max_by(values, F.struct(time, *tiebreak)).alias("_last")
    )
    # One row per slice of the key that holds rows: a bounded group.
    by_slice = Window.partitionBy(*slices.keys).orderBy(SLICE)
    return last.select(
        *slices.keys, SLICE, F.lag("_last").over(by_slice).alias(_CARRY)
    ).where(F.col(_CARRY).isNotNull())


def change(now: Column, before: Column, first: float | None = None) -> Column:
    """Difference to the observation before. ``first`` is the value where there is none."""
    difference = now - before
    return difference if first is None else F.coalesce(difference, F.lit(float(first)))


def is_sale(stock_change: Column) -> Column:
    """Stock went down. An unknown change is no sale."""
    return F.coalesce(stock_change < 0, F.lit(False))


def is_movement(stock_change: Column, first_counts: bool = True) -> Column:
    """Stock changed. ``first_counts``: an unknown change (first observation) counts too."""
    return F.coalesce(stock_change != 0, F.lit(first_counts))


def step_revenue_doubled(
    price_before: Column, price: Column, stock_change: Column
) -> Column:
    """Twice the revenue of one step: (price before + price now) * units gone.

    Kept doubled so that amounts of money stay on whole cents until after the sum.
    """
    return (price_before + price) * -stock_change


def any_per_key(rows: DataFrame, key: str, flag: str, new: str) -> DataFrame:
    """Put on every row whether any row of its key has the flag."""
    return _with_aggregate(rows, key, F.bool_or(flag).alias(new))


def last_per_key(
    rows: DataFrame, key: str, value: str, time: str, tiebreak: Sequence[str], new: str
) -> DataFrame:
    """Put on every row the value of the latest row of its key."""
    return _with_aggregate(rows, key, F.max_by(value, F.struct(time, *tiebreak)).alias(new))


def _with_aggregate(rows: DataFrame, key: str, aggregate: Column) -> DataFrame:
    """Aggregate by key and join back.

    A window would send all rows of a key through one task. The aggregate combines before
    its shuffle, and adaptive execution splits a hot key on the rows' side of the left join.
    """
    return rows.join(rows.groupBy(key).agg(aggregate), key, "left")
