"""Dates and times. Nothing here reads the clock: the report date is a parameter."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lookback_start(as_of: date, days: int) -> date:
    return as_of - timedelta(days=days)


def to_time(text: Column) -> Column:
    """Text to a timestamp without time zone; unreadable text becomes NULL."""
    return text.try_cast("timestamp_ntz")


def day_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def shift_days(day: Column, days: int) -> Column:
    return F.date_add(day, days)


def seconds_of(time: Column, kind: T.DataType) -> Column:
    """Seconds on a scale that never runs backwards, whatever the session time zone."""
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(time)
    day = F.unix_date(F.to_date(time)).cast("long") * 86400
    if isinstance(kind, T.DateType):
        return day
    if isinstance(kind, T.TimestampNTZType):
        return day + F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)
    raise TypeError(f"not a date or time: {kind.simpleString()}")
