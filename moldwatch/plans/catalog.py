"""Registry of named queries: each is (spark, sf_dir) -> DataFrame plus the
SQL text an independent engine runs on the same tables."""
from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from moldwatch.plans import queries_core, queries_join, queries_rolling, queries_monitor, queries_eval, queries_forecast, queries_ml, queries_live, queries_room, queries_io, queries_records  # noqa: F401
