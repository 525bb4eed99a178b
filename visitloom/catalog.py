"""All queries of the library over the driver's tables, by operator id, and the SQL that says the same."""

from __future__ import annotations

import importlib

from visitloom.plans.registry import QUERIES, SQL, Query

MODULES = ("rows", "aggregates", "joins", "scalars", "windows", "updates", "rulebase", "extraction", "roles", "visits", "vectors", "files")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"visitloom.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
