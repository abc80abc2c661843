"""Parameters of the reports."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from vitrine.operators.skew import DEFAULT_POLICY, SkewPolicy, Slices

# The categories reported on when none are named, and the look-back.
DEFAULT_TARGETS = (
    "celulares y telefonía",
    "computación",
    "cámaras y accesorios",
    "electrónica",
    "consolas y videojuegos",
)
DEFAULT_LOOKBACK_DAYS = 30


@dataclass(frozen=True)
class Scope:
    """What a report looks at.

    as_of: report date; None means all observations, and no stock of the day.
    targets: categories to keep; None keeps every category.
    tiebreak: observation columns that order rows of equal time.
    one_row_per_listing: True says that the listing table has one row per url; otherwise it is
        reduced to the newest row of each first.
    slices: how hot listings are cut, if found already (plans.inputs.listing_slices).
    """

    as_of: date | None = None
    lookback_days: int = DEFAULT_LOOKBACK_DAYS
    targets: tuple[str, ...] | None = DEFAULT_TARGETS
    match_case: bool = False
    tiebreak: tuple[str, ...] = ()
    one_row_per_listing: bool = False
    skew: SkewPolicy = field(default=DEFAULT_POLICY)
    slices: Slices | None = None
