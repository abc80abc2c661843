"""Row generators: one row per element of a list column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_element(rows: DataFrame, column: str) -> DataFrame:
    """One row per element in place of the list; an empty or NULL list gives one NULL row."""
    return rows.withColumn(column, F.explode_outer(column))


def per_distinct_element(rows: DataFrame, column: str, new: str, times: str) -> DataFrame:
    """One row per different element, with the number of times it is in the list.

    Lists without elements give no row: a missing group key is never reported.
    """
    kept = [name for name in rows.columns if name != column]
    element = rows.select(
        *kept, column, F.explode(F.array_distinct(F.array_compact(column))).alias(new)
    )
    count = F.size(F.filter(F.col(column), lambda other: other == F.col(new)))
    return element.withColumn(times, count).drop(column)
