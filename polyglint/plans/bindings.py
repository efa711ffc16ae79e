"""All queries of the localization operators, bound to the driver's tables."""

from __future__ import annotations

from . import changing, counting, naming, publishing, reading, recovering, relating  # noqa: F401  (they register their queries)
from .relations import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
