"""Every registered query of the crawl engine and its DuckDB counterpart."""

from __future__ import annotations

QUERY_MODULES: tuple[str, ...] = ("crawlscape.plans.web", "crawlscape.plans.content", "crawlscape.plans.graph", "crawlscape.plans.history", "crawlscape.plans.fleet", "crawlscape.plans.control")


def _collect(attribute: str) -> dict:
    from importlib import import_module

    found: dict = {}
    for name in QUERY_MODULES:
        found |= getattr(import_module(name), attribute)
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE")
