"""Numbers held as text, and the arithmetic of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain cast to double would also take '1d', '1f' and hexadecimal floats. Text that reads as a
# decimal is none of these; only what is left over is looked at with the slower patterns.
_PLAIN = "decimal(38,10)"
_FINITE = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"
_INFINITE = r"^\s*[+-]?(?i:inf(?:inity)?)\s*$"
# Sums of money and stock are taken in decimal, so they do not depend on row order.
_EXACT = "decimal(28,6)"


def to_number(text: Column) -> Column:
    """Text to double; what is no number, NaN or too large becomes NULL."""
    number = text.try_cast("double")
    finite = F.when(F.abs(number) < F.lit(float("inf")), number)
    return (
        F.when(text.try_cast(_PLAIN).isNotNull(), number)
        .when(text.rlike(_FINITE), finite)
        .when(text.rlike(_INFINITE), number)
    )


def to_number_strict(text: Column) -> Column:
    """Text to double; text that is no number stops the job."""
    number = to_number(text)
    complaint = F.raise_error(F.concat(F.lit("not a number: "), text.cast("string")))
    return F.when(text.isNull() | number.isNotNull(), number).otherwise(
        complaint.cast("double")
    )


def or_zero(number: Column) -> Column:
    return F.coalesce(number, F.lit(0).cast("double"))


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100``; NULL when the whole is 0 or NULL."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def at_least_zero(number: Column) -> Column:
    return F.when(number.isNotNull(), F.greatest(number, F.lit(0).cast("double")))


def at_most_zero(number: Column) -> Column:
    return F.when(number.isNotNull(), F.least(number, F.lit(0).cast("double")))


def midpoint(before: Column, now: Column) -> Column:
    return (before + now) / 2


def exact(number: Column) -> Column:
    """The number in decimal, for sums; NULL when it is too large for that."""
    return number.try_cast(_EXACT)


def exact_sum(number: Column, times: Column | None = None) -> Column:
    """Aggregate: sum of numbers, each counted ``times`` times, that keeps every digit.

    What fits into six decimal places is added up in decimal, whatever the order of the rows; what
    a number has beyond (tiny, giant and infinite ones) is added up as doubles. For money nothing
    is left over.
    """
    kept = exact(number)
    left = number - F.coalesce(kept.cast("double"), F.lit(0.0))
    if times is not None:
        kept, left = kept * times, left * times
    return F.coalesce(F.sum(kept).cast("double"), F.lit(0.0)) + F.sum(left)
