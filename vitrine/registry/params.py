"""Parameters of the registered queries."""

from __future__ import annotations

from datetime import date

from vitrine.operators.skew import SkewPolicy
from vitrine.plans.config import Scope

AS_OF = date(2000, 6, 30)
DAYS = 365
TARGETS = ("economy", "promo")
TIE = ("l_orderkey", "l_linenumber")
SCOPE = Scope(
    as_of=AS_OF, lookback_days=DAYS, targets=TARGETS, tiebreak=TIE, one_row_per_listing=True
)
EVERYTHING = Scope(as_of=None, targets=None, tiebreak=TIE, one_row_per_listing=True)

SINCE_SQL = "created >= TIMESTAMP '1999-07-01'"  # 365 days before the report date
TARGET_SQL = "(path LIKE '%economy%' OR path LIKE '%promo%')"

# Makes the plan for hot listings the plan for all but the smallest.
SLICED = SkewPolicy(min_rows=20, oversplit=2)
