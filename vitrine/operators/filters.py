"""Row predicates."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.dates import lookback_start


def since(time: Column, as_of: date, days: int) -> Column:
    """Within the look-back window that ends at the report date."""
    return time >= F.lit(lookback_start(as_of, days))


def between(time: Column, start: date | datetime, end: date | datetime) -> Column:
    """Closed range. A plain date as end means its midnight: later rows of that day are out."""
    return (time >= F.lit(start)) & (time <= F.lit(end))


def in_days(time: Column, start: date, end: date) -> Column:
    """Half-open range of whole days, start included, end excluded."""
    return (time >= F.lit(start)) & (time < F.lit(end))


def on_day(time: Column, day: date) -> Column:
    """On one calendar day, written as a range so that it reaches the scan."""
    return in_days(time, day, day + timedelta(days=1))


def key_equals(key: Column, value: object) -> Column:
    return key == F.lit(value)


def in_any_category(path: Column, targets: Sequence[str], match_case: bool = False) -> Column:
    """Any target is a part of the path. A NULL or empty path is in no category."""
    if not targets:
        return F.lit(False)
    if not match_case:
        path = F.lower(path)
        targets = [target.lower() for target in targets]
    # One pattern of literal texts, so that the path, often parsed from JSON, is made only once.
    # An empty target is part of every path that is not empty itself.
    parts = [re.escape(target) if target else "." for target in targets]
    return F.coalesce(path.rlike("(?s)" + "|".join(parts)), F.lit(False))


def in_stock(quantity: Column) -> Column:
    return quantity > 0


def drop_missing(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows with a value in every column. Written so that it reaches scans and joins."""
    for column in columns:
        rows = rows.where(F.col(column).isNotNull())
    return rows
