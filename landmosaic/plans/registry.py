"""The registered queries and their oracles by name."""

from __future__ import annotations

from collections.abc import Callable

FLAGSHIP = "selection_ratio"
QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its oracle if SQL can express it."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


from . import diagnosis, files, grids, habitat, negatives, patches, points, scoring  # noqa: E402, F401
