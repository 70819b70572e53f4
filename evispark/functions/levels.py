"""Evidence-level weights. Each operator has a table of its own; they differ on purpose. All are fixed values."""

from __future__ import annotations

from pyspark.sql import Column

from evispark.sources.tables import choose

ORDER = ("1a", "1b", "2a", "2b", "2c", "3a", "3b", "4", "5")

HYBRID = {"1a": 1.0, "1b": 0.9, "2a": 0.8, "2b": 0.7, "3": 0.5, "4": 0.3, "5": 0.1}
SYNTHESIS = {"1a": 1.0, "1b": 0.9, "2a": 0.7, "2b": 0.6, "3": 0.4, "4": 0.2, "5": 0.1}
CONFLICT = {"1a": 10.0, "1b": 9.0, "2a": 8.0, "2b": 7.0, "3": 5.0, "4": 3.0, "5": 1.0}
MULTI_FACTOR = {"1a": 1.0, "1b": 0.95, "2a": 0.8, "2b": 0.7, "2c": 0.65, "3a": 0.55, "3b": 0.5, "4": 0.35, "5": 0.2}
REASONER = {"1a": 1.0, "1b": 0.95, "2a": 0.8, "2b": 0.75, "2c": 0.7, "3a": 0.6, "3b": 0.55, "4": 0.4, "5": 0.25}
CLINICAL = {"1a": 1.0, "1b": 0.9, "2a": 0.8, "2b": 0.7, "3": 0.5, "4": 0.3, "5": 0.1}


def weight(column: str, table: dict[str, float], default: float) -> Column:
    return choose(column, table, default)


def rank(column: str, last: int) -> Column:
    """Position of a level in an ORDER BY: strongest 1, others ``last``."""
    return choose(column, {"1a": 1, "1b": 2, "2a": 3, "2b": 4}, last)


def case_sql(column: str, table: dict, default) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {_number(v)}" for k, v in table.items())
    return f"CASE {column} {whens} ELSE {_number(default)} END"


def _number(v) -> str:
    return f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
