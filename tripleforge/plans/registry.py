"""All queries of the library and the SQL that states the same result, without those of optional subpackages."""

from __future__ import annotations

from tripleforge.plans import detail_queries, graph_queries, media_queries, preparation, table_queries

_MODULES = [graph_queries, table_queries, media_queries, detail_queries, preparation]


def queries() -> dict:
    """Name to callable (spark, directory of the tables) of every query."""
    return {name: f for module in _MODULES for name, f in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    """Name to SQL for the queries that SQL can express."""
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
