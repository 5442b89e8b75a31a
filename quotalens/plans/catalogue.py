"""Every registered query of the quota and usage engine, with its DuckDB SQL (None where SQL cannot express it)."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("usage", "quotas", "insights", "reports", "value", "current", "sources", "stores", "periods")


def _all() -> dict:
    found: dict = {}
    for family in FAMILIES:
        found |= import_module(f"{__package__}.{family}").QUERIES
    return found


def queries() -> dict:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
