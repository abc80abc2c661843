"""Every operator and report as a query over the given tables, with the SQL that checks it."""

from vitrine.registry import (  # noqa: F401  (importing registers the queries)
    aggregates,
    joins,
    ordering,
    panel,
    predicates,
    reports,
    scalars,
    scans,
)
from vitrine.registry import stored  # noqa: F401,E402  (needs the queries above)
from vitrine.registry.book import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
