"""Registry of the library's queries and their DuckDB oracles."""

from __future__ import annotations

from . import research, transforms


def queries() -> dict:
    return transforms.queries() | research.queries()


def oracle_sql() -> dict[str, str]:
    return transforms.oracle_sql() | research.oracle_sql()
