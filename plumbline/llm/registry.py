"""Queries of the training-data operators by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from plumbline.llm import epoch_sampling, formatting_dedup, leakage, mixing, near_duplicates, proportional_sampling, subject_areas, truncation

_MODULES = [epoch_sampling, formatting_dedup, leakage, mixing, near_duplicates, proportional_sampling, subject_areas, truncation]


def queries() -> dict:
    """All queries of this subpackage."""
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
