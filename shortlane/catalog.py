"""All queries over the driver's tables, by name, with their DuckDB SQL."""

from __future__ import annotations

from shortlane.plans import lookup, ranking, validation


def queries() -> dict:
    return ranking.QUERIES | validation.QUERIES | lookup.QUERIES


def oracle_sql() -> dict[str, str]:
    return ranking.SQL | validation.SQL | lookup.SQL
