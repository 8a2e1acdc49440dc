"""All registered queries by name, with their SQL equivalents."""

from __future__ import annotations

from placeweave.plans import collecting, dates, details, metrics, places, publishing, resolving, reviewing  # noqa: F401  (they register)
from placeweave.plans.registry import QUERIES, SQL, Query

FLAGSHIP: Query = QUERIES["E17_resolve_classify"]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
