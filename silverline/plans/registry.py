"""Registry of the library's queries: Spark callable + DuckDB twin + survey ids.

Every entry reads the driver's tables (or tables Spark derives from them)
under ``sf_dir``; ``sql`` is the DuckDB oracle text, or None when the result
is not expressible in SQL (then only row counts are compared).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Query:
    name: str
    fn: Callable
    sql: str | None
    ids: list[str] = field(default_factory=list)


QUERIES: dict[str, Query] = {}


def register(name: str, ids: list[str] | str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql, [ids] if isinstance(ids, str) else list(ids))
        return fn

    return deco


def load_all() -> dict[str, Query]:
    # importing the modules fills QUERIES
    from silverline.plans import queries_quality  # noqa: F401

    for mod in ["queries_docs", "queries_usage", "queries_catalog", "queries_sql", "queries_routing",
                "queries_io", "queries_schema", "queries_streaming"]:
        try:
            __import__(f"silverline.plans.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"silverline.plans.{mod}":
                raise
    return QUERIES
