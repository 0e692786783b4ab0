"""Every registered query of the relational engine, by name, with its SQL twin."""

from __future__ import annotations

from millrace.plans import aggregates, changes, engines, estimates, extras, files, relational, relations, scalars, vectors, windows  # noqa: F401
from millrace.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
