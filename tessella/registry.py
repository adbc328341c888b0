"""Collects the registered queries of the plan modules."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
PLAN_MODULES: tuple[str, ...] = ("curation", "evaluation", "text", "records", "alignment", "decisions", "models", "ledger", "provenance", "context", "evidence")


def query(sql: str | None = None) -> Callable:
    """Registers the decorated function under its own name, with its DuckDB SQL."""

    def keep(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def _load() -> None:
    from importlib import import_module

    for name in PLAN_MODULES:
        import_module(f"tessella.plans.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLES
