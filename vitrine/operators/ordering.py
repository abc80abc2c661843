"""Distinct, sort, page, latest rows, and putting slices together."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.operators.filters import in_days
from vitrine.session import written


def distinct_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key).distinct()


def by_listing_newest_first(rows: DataFrame, key: str, time: str, *tiebreak: str) -> DataFrame:
    """Listing ascending, newest first; rows without a time come last."""
    return rows.orderBy(F.col(key).asc_nulls_last(), F.col(time).desc_nulls_last(), *tiebreak)


@dataclass(frozen=True)
class By:
    """A column of a total order. As in SQL, NULL comes first ascending and last descending."""

    name: str
    descending: bool = False

    @property
    def sort(self) -> Column:
        return F.col(self.name).desc() if self.descending else F.col(self.name).asc()

    def beyond(self, value: Column, is_null: bool) -> Column:
        """Rows that come after the value in this column."""
        column = F.col(self.name)
        if self.descending:
            return F.lit(False) if is_null else (column < value) | column.isNull()
        return column.isNotNull() if is_null else column > value


def ordered_by(*order: str | By) -> tuple[By, ...]:
    """``"name"`` is ascending, ``"name desc"`` descending."""

    def parsed(item: str | By) -> By:
        if isinstance(item, By):
            return item
        name, _, direction = item.partition(" ")
        if direction.lower() not in ("", "asc", "desc"):
            raise ValueError(f"no such direction: {direction}")
        return By(name, direction.lower() == "desc")

    return tuple(map(parsed, order))


@dataclass(frozen=True)
class RangeIndex:
    """Where a total order is cut into ranges: their first keys and how many rows they hold.

    Small, whatever the table: a row for each range. With it any page is read from the source by
    the bounds of the one or two ranges it touches.
    """

    order: tuple[By, ...]
    types: tuple[T.DataType, ...]
    firsts: tuple[tuple, ...]
    counts: tuple[int, ...]

    @classmethod
    def of(cls, rows: DataFrame, order: Sequence[str | By], ranges: int | None = None) -> RangeIndex:
        """Deals out the keys by ranges. No other column is read."""
        by = ordered_by(*order)
        keys = rows.select(*[b.name for b in by])
        n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sort = [b.sort for b in by]
        part, nth, size = "_range", "_nth", "_size"
        dealt = keys.repartitionByRange(n, *sort).withColumn(part, F.spark_partition_id())
        dealt = written(dealt)
        first = Window.partitionBy(part).orderBy(*sort)
        firsts = dealt.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1)
        counts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias(size))
        found = firsts.join(counts, part).orderBy(part).collect()
        types = tuple(keys.schema[b.name].dataType for b in by)
        return cls(
            by,
            types,
            tuple(tuple(row[b.name] for b in by) for row in found),
            tuple(row[size] for row in found),
        )

    def _after(self, key: tuple, or_at: bool) -> Column:
        """Rows that come after the key, or are at it."""
        out, equal = F.lit(False), F.lit(True)
        for by, value, kind in zip(self.order, key, self.types):
            literal = F.lit(value).cast(kind)
            out = out | (equal & by.beyond(literal, value is None))
            equal = equal & F.col(by.name).eqNullSafe(literal)
        return self._leading(key) & (out | equal if or_at else out)

    def _leading(self, key: tuple) -> Column:
        """What follows for the first column alone, in a form that reaches the files."""
        by, value = self.order[0], key[0]
        if value is None or by.descending:
            return F.lit(True)
        return F.col(by.name) >= F.lit(value).cast(self.types[0])

    def _before(self, key: tuple) -> Column:
        by, value = self.order[0], key[0]
        bound = F.lit(True)
        if value is not None and by.descending:
            bound = F.col(by.name) >= F.lit(value).cast(self.types[0])
        elif value is not None:
            column = F.col(by.name)
            bound = column.isNull() | (column <= F.lit(value).cast(self.types[0]))
        return bound & ~F.coalesce(self._after(key, or_at=True), F.lit(False))

    def page(self, rows: DataFrame, offset: int, size: int) -> DataFrame:
        """Rows [offset, offset + size) of the order, read from the ranges that hold them."""
        needed, before, at = [], 0, 0
        for number, count in enumerate(self.counts):
            first, at = at, at + count
            if at <= offset:
                before = at
            elif first < offset + size:
                needed.append(number)
        if not needed:
            return rows.limit(0)
        found = rows.where(self._after(self.firsts[needed[0]], or_at=True))
        if needed[-1] + 1 < len(self.firsts):
            found = found.where(self._before(self.firsts[needed[-1] + 1]))
        return found.orderBy(*[by.sort for by in self.order]).offset(offset - before).limit(size)

    def after(self, rows: DataFrame, key: Sequence, size: int) -> DataFrame:
        """The next rows after a key, such as the last one of the page before.

        Needs no count of what comes earlier, and stays right when rows are added meanwhile. Each
        task keeps its first rows, only those are merged.
        """
        wanted = rows.where(self._after(tuple(key), or_at=False))
        return wanted.orderBy(*[by.sort for by in self.order]).limit(size)


def page(rows: DataFrame, order: Sequence[str | By], offset: int, size: int) -> DataFrame:
    """One page of a total order. For several pages, make the RangeIndex once."""
    return RangeIndex.of(rows, order).page(rows, offset, size)


def page_after(rows: DataFrame, order: Sequence[str | By], key: Sequence, size: int) -> DataFrame:
    """The rows that follow a key in the order. No index is needed."""
    by = ordered_by(*order)
    types = tuple(rows.schema[b.name].dataType for b in by)
    return RangeIndex(by, types, (), ()).after(rows, key, size)


def latest(rows: DataFrame, n: int, time: str, *tiebreak: str) -> DataFrame:
    """The n newest rows. Each task keeps its own n, only those are merged."""
    order = [F.col(time).desc_nulls_last(), *[F.col(name).desc() for name in tiebreak]]
    return rows.orderBy(*order).limit(n)


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of frames with the same columns, for frames that come from different sources.

    Slices of one table are better read in one scan: see sweep_days.
    """
    return reduce(DataFrame.unionByName, frames)


def sweep_days(
    rows: DataFrame, time: str, start: date, end: date, day: str = "snapshot_date"
) -> DataFrame:
    """All day slices of ``[start, end)`` in one scan, each row with its day."""
    return rows.where(in_days(F.col(time), start, end)).withColumn(day, F.to_date(time))
