"""Queries with the operators they show and, where SQL can express them, their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from .standins import SQL, duck


@dataclass(frozen=True)
class Query:
    run: Callable
    ids: str
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(ids: str, sql: str | None = None):
    """Registers a function of the stand-in tables. In sql, @name stands for a stand-in."""

    def add(f: Callable) -> Callable:
        filled = re.sub(r"@(\w+)", lambda m: duck(m[1]) if m[1] in SQL else m[0], sql) if sql else None
        QUERIES[f.__name__] = Query(f, ids, filled)
        return f

    return add


def load() -> None:
    """Imports the modules that register queries."""
    from . import byte_queries, storage_queries, upkeep_queries  # noqa: F401
