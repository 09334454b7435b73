"""Named queries: each module holds QUERIES (name to function) and SQL (name to the same query in ANSI SQL)."""

from __future__ import annotations

from types import ModuleType


def modules() -> tuple[ModuleType, ...]:
    """The modules of queries, imported when asked for."""
    from lexiweave.plans import analytics, graphs, lookups, neighbours, quality, tiers, upkeep

    return (lookups, neighbours, tiers, graphs, analytics, upkeep, quality)
