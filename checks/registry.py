"""Name -> (query, SQL) table filled by the ``checks.q_*`` modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from checks.fixtures import Inputs, ctes

QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, variant: str | None = "error"):
    """Register a query; ``sql`` may use the tables :func:`checks.fixtures.ctes` defines.

    ``variant=None`` means the SQL is complete as it stands.
    """

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql if variant is None else extend(ctes(variant), sql)
        return fn

    return add


def extend(prefix: str, sql: str) -> str:
    """Put further CTEs (SQL starting with ``,``) or a final select behind the prefix."""
    return prefix + sql
