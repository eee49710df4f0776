"""Named queries over the driver's tables, with their SQL twins."""

from __future__ import annotations

from corvane.plans import derived, problems, reads, store, upkeep, whole

_MODULES = [problems, store, derived, reads, upkeep, whole]


def all_queries() -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= m.QUERIES
    return out


def all_sql() -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= m.SQL
    return out
