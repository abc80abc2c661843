"""Groups that hold very many rows, and how they are split.

A window over one listing's history needs the rows of that listing in time order.
When one listing holds, say, a third of all rows, that is one task. So the history
of such a listing is cut into slices by time: each slice is a group of its own in
the shuffle, and what must cross a border (the last row of the slice before) is a
small table of one row per slice.

Which listings are hot is estimated on a sample of the key column, or known from a summary kept
with the table (storage.hot_keys). That only decides how rows are spread: any choice of hot keys
and of slices gives the same result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import ClassVar

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions.dates import seconds_of
from vitrine.session import written

SLICE = "_slice"
_COPY = "_copied"
# A hot key's history is first cut into this many intervals of about as many rows each.
_INTERVALS = 32
# Rows of a hot key that its borders are taken from.
_POINTS = 4096


@dataclass(frozen=True)
class SkewPolicy:
    """When a group counts as hot, however many rows the table has.

    min_rows: one task copes with this many rows; a group that holds more is hot.
    hits: rows of such a group the sample is expected to hold. The sample is hits / min_rows of
        the table, so it stays far smaller than the table and finds every hot group.
    oversplit: slices per min_rows rows, because rows may be uneven in time.
    """

    min_rows: int = 1_000_000
    hits: float = 50
    oversplit: int = 8
    enabled: bool = True

    def __post_init__(self) -> None:
        if self.min_rows < 1 or self.hits <= 0 or self.oversplit < 1:
            raise ValueError("min_rows, hits and oversplit must be positive")

    @property
    def fraction(self) -> float:
        return min(1.0, self.hits / self.min_rows)

    def thin(self, rows: DataFrame) -> DataFrame:
        """The sample to look for hot keys in. Never a source of results."""
        return rows.sample(self.fraction, seed=7) if self.fraction < 1 else rows


DEFAULT_POLICY = SkewPolicy()


@dataclass(frozen=True)
class Slices:
    """The hot keys of one fact table, with the borders and slice count of each.

    tiebreak: columns that order rows of equal time; borders may lie between such rows.
    """

    #: Slices that one share of `_parts` stands for.
    intervals: ClassVar[int] = _INTERVALS

    keys: tuple[str, ...]
    time: str
    tiebreak: tuple[str, ...] = ()
    hot: DataFrame | None = None

    @property
    def any(self) -> bool:
        return self.hot is not None

    def on_key(self, *keys: str) -> Slices:
        """The same layout for a frame whose key columns have other names."""
        if self.hot is None:
            return replace(self, keys=keys)
        renamed = self.hot.withColumnsRenamed(dict(zip(self.keys, keys)))
        return replace(self, keys=keys, hot=renamed)

    def label(self, rows: DataFrame, only_hot: bool = False) -> DataFrame:
        """Add the slice number. Rows of other listings are all in slice 0.

        The table of hot keys is joined as its size tells Spark to. Rows that carry their number,
        as stored ones do, keep it.
        """
        if SLICE in rows.columns:
            return self.only_hot(rows) if only_hot else rows
        at, interval, bounds = F.col("_at"), F.col("_interval"), F.col("_bounds")
        place = _place(rows, self.time, self.tiebreak)
        marked = rows.withColumn("_at", place).join(
            self.hot, list(self.keys), "inner" if only_hot else "left"
        )
        # The interval of the row's place, then its even share of the interval's time. Both only
        # grow along the history, so the slices of a key follow each other. A row without a time
        # comes first, as in a sort.
        passed = F.size(F.filter(bounds, lambda bound: bound <= at))
        inside = F.least(F.greatest(passed, F.lit(1)), F.lit(_INTERVALS)) - 1
        start = F.element_at(bounds, interval + 1)["at"]
        width = F.element_at(bounds, interval + 2)["at"] - start + 1
        spot = F.floor((at["at"] - start) * F.col("_parts") / width)
        part = F.least(F.greatest(spot, F.lit(0)), F.col("_parts") - 1)
        number = F.when(F.col("_parts").isNotNull(), interval * F.col("_parts") + part)
        return (
            marked.withColumn("_interval", inside)
            .withColumn(SLICE, F.coalesce(number, F.lit(0)).cast("int"))
            .drop("_at", "_interval", "_bounds", "_parts")
        )

    def only_hot(self, rows: DataFrame) -> DataFrame:
        """Rows of hot keys."""
        return rows.join(self.hot.select(*self.keys), list(self.keys), "left_semi")

    def copy_to_slices(self, dimension: DataFrame, key: Sequence[str]) -> DataFrame:
        """One copy of a hot key's dimension row per slice, to meet the slices in a join."""
        hot = self.hot.select(
            *[F.col(mine).alias(theirs) for mine, theirs in zip(self.keys, key)],
            "_parts",
        )
        marked = dimension.join(hot, list(key), "left")
        count = F.coalesce(F.col("_parts") * self.intervals, F.lit(1))
        slices = F.sequence(F.lit(0), count - 1)
        return (
            marked.withColumn(SLICE, F.explode(slices))
            .withColumn(_COPY, F.col("_parts").isNotNull())
            .drop("_parts")
        )


@dataclass(frozen=True)
class Spread(Slices):
    """For a join only: the rows of a hot key are dealt out evenly, in no order."""

    intervals: ClassVar[int] = 1

    def label(self, rows: DataFrame, only_hot: bool = False) -> DataFrame:
        if SLICE in rows.columns:
            return self.only_hot(rows) if only_hot else rows
        address = row_address(rows)
        if address is not None:
            rows = rows.withColumn("_at", address)
        marked = rows.join(self.hot, list(self.keys), "inner" if only_hot else "left")
        # Without an address the whole row is hashed, that of hot keys only.
        at = F.col("_at") if address is not None else _row_hash(rows)
        number = F.when(F.col("_parts").isNotNull(), F.pmod(at, F.col("_parts")))
        return marked.withColumn(SLICE, F.coalesce(number, F.lit(0)).cast("int")).drop("_at", "_parts")


def row_address(rows: DataFrame) -> Column | None:
    """Where in its file a row lies, if the rows come straight from files that tell."""
    address = F.col("_metadata.row_index")
    try:
        rows.select(address).schema  # noqa: B018  (analysed here)
    except AnalysisException:
        return None
    return address


def _row_hash(rows: DataFrame) -> Column:
    plain = [f.name for f in rows.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(*plain)


def _place(rows: DataFrame, time: str, tiebreak: Sequence[str]) -> Column:
    """Where a row stands in its key's history, as something that can be compared."""
    seconds = seconds_of(F.col(time), rows.schema[time].dataType).cast("double")
    return F.struct(seconds.alias("at"), *tiebreak)


def hot_keys(sample: DataFrame, keys: Sequence[str], policy: SkewPolicy) -> DataFrame:
    """(keys, _rows): keys with more than ``min_rows`` rows of the table, judged by a sample of it."""
    bar = policy.min_rows * policy.fraction
    counts = sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= bar)
    return counts.select(*keys, (F.col("_n") / policy.fraction).alias("_rows"))


def find_hot_keys(facts: DataFrame, keys: Sequence[str], policy: SkewPolicy) -> DataFrame | None:
    """The hot keys in a written table, or None. Reads a sample of the key columns only.

    Nothing but the answer whether there is a hot key reaches the driver.
    """
    known = facts.select(*keys).where(_all_present(keys))
    hot = hot_keys(policy.thin(known), keys, policy)
    return None if hot.isEmpty() else written(hot)


def plan_slices(
    facts: DataFrame,
    keys: Sequence[str],
    time: str,
    policy: SkewPolicy = DEFAULT_POLICY,
    tiebreak: Sequence[str] = (),
    hot: DataFrame | None = None,
) -> Slices:
    """Look for hot keys and lay out their slices.

    One job over a sample of the keys tells whether there is any hot key; only then their borders
    are looked for, in a second job over key, time and tie-break.
    hot: the hot keys (keys, _rows), if known.
    """
    plain = Slices(tuple(keys), time, tuple(tiebreak))
    if not policy.enabled:
        return plain
    if hot is None:
        hot = find_hot_keys(facts, keys, policy)
    if hot is None:
        return plain
    # Some thousand rows of each hot key, whatever its size.
    points = facts.select(*keys, _place(facts, time, tiebreak).alias("_at")).join(hot, list(keys))
    points = points.where(F.col("_at")["at"].isNotNull() & (F.rand(7) < _POINTS / F.col("_rows")))
    shares = F.sequence(F.lit(0), F.lit(_INTERVALS))
    ordered = F.col("_ordered")
    parts = F.ceil(F.col("_rows") / policy.min_rows * policy.oversplit / _INTERVALS)
    laid_out = written(
        points.groupBy(*keys)
        .agg(F.sort_array(F.collect_list("_at")).alias("_ordered"), F.max("_rows").alias("_rows"))
        .select(
            *keys,
            parts.cast("int").alias("_parts"),
            F.transform(
                shares,
                lambda n: F.element_at(
                    ordered, F.floor(n * (F.size(ordered) - 1) / _INTERVALS).cast("int") + 1
                ),
            ).alias("_bounds"),
        )
    )
    return replace(plain, hot=laid_out)


def _all_present(keys: Sequence[str]) -> Column:
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()
    return present


def plan_spread(
    facts: DataFrame, key: str, policy: SkewPolicy, hot: DataFrame | None = None
) -> Spread:
    """Slices for a join only. Reads a sample of the key, and nothing if ``hot`` is known."""
    if policy.enabled and hot is None:
        hot = find_hot_keys(facts, [key], policy)
    if not policy.enabled or hot is None:
        return Spread((key,), "")
    parts = F.ceil(F.col("_rows") / policy.min_rows * policy.oversplit)
    return Spread((key,), "", (), hot.select(key, parts.cast("int").alias("_parts")))


def join_facts(
    dimension: DataFrame,
    facts: DataFrame,
    on: tuple[str, str],
    how: str,
    slices: Slices,
) -> DataFrame:
    """Join a dimension (left) with facts (right) whose hot keys are spread over slices.

    Adaptive execution splits a skewed side of an inner join on its own, but never the
    side that a left or full join fills with NULLs. Here hot keys are split in every join
    type; the slices stay on the rows, so a later window over them needs no new shuffle.
    """
    left_key, right_key = on
    if SLICE in facts.columns and not slices.any:
        facts = facts.drop(SLICE)
    shared = set(dimension.columns) & set(facts.columns)
    if shared:
        raise ValueError(f"rename the columns found on both sides: {sorted(shared)}")
    how = {"outer": "full", "full_outer": "full", "left_outer": "left", "right_outer": "right"}.get(how, how)
    columns = [name for name in (*dimension.columns, *facts.columns) if name != SLICE]
    # Rows without a key meet none. In a shuffle they would all meet in one task.
    lonely = []
    if how in ("left", "full"):
        lonely.append(_filled(dimension.where(F.col(left_key).isNull()), facts))
    if how in ("right", "full"):
        lonely.append(_filled(facts.where(F.col(right_key).isNull()), dimension))
    dimension = dimension.where(F.col(left_key).isNotNull())
    facts = facts.where(F.col(right_key).isNotNull())
    joined = _join_known(dimension, facts, on, how, slices)
    for part in lonely:
        part = part.withColumn(SLICE, F.lit(0)) if slices.any else part
        joined = joined.unionByName(part)
    return joined.select(*columns, *([SLICE] if slices.any else []))


def _filled(rows: DataFrame, other: DataFrame) -> DataFrame:
    """The rows with the other side's columns, all NULL."""
    return rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in other.schema])


def _join_known(
    dimension: DataFrame, facts: DataFrame, on: tuple[str, str], how: str, slices: Slices
) -> DataFrame:
    left_key, right_key = on
    same_key = F.col(left_key) == F.col(right_key)
    if not slices.any:
        return dimension.join(facts, same_key, how)
    spread = slices.label(facts).withColumnRenamed(SLICE, "_fact_slice")
    joined = slices.copy_to_slices(dimension, [left_key]).join(
        spread, same_key & (F.col(SLICE) == F.col("_fact_slice")), how
    )
    if how != "inner":
        # A hot key has facts by definition, so a copy that met none is only a spare.
        spare = F.coalesce(F.col(_COPY), F.lit(False)) & F.col(right_key).isNull()
        joined = joined.where(~spare)
    if how in ("full", "right"):
        joined = joined.withColumn(SLICE, F.coalesce(SLICE, "_fact_slice"))
    return joined.drop(_COPY, "_fact_slice")
