"""The query catalogue: one entry per operator, with DuckDB SQL where SQL expresses it."""

from __future__ import annotations

from quillon.plans import core, feeds, metric, more, relations, weekly

_MODULES = (weekly, core, metric, more, relations, feeds)


def queries():
    """Name -> (spark, sf_dir) -> DataFrame."""
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    """Name -> DuckDB SQL."""
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
