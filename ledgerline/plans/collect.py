"""Collections of queries with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

_COUNT_IF = re.compile(r"count_if\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)")


def collection(ctes: str = "") -> tuple[dict, dict[str, str], Callable]:
    """(queries, oracles, decorator): the decorator registers a query under its
    name with its SQL, under the given common table expressions unless others are named."""
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None, ctes: str = ctes) -> Callable:
        def add(f):
            queries[f.__name__] = f
            if sql:
                text = (f"WITH {ctes} " if ctes else "") + sql
                oracles[f.__name__] = _COUNT_IF.sub(r"count(CASE WHEN \1 THEN 1 END)", text)  # a plain long
            return f

        return add

    return queries, oracles, query
