"""All oracle texts in one dictionary."""

from __future__ import annotations

from . import oracle_more, oracle_queries


def oracle_sql() -> dict[str, str]:
    return {**oracle_queries.oracle(), **oracle_more.oracle()}
