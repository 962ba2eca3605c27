"""Registered queries and their DuckDB oracles (see ``areascope.queries``)."""

from areascope.queries import _LAYERS, ORACLE, QUERIES, Layers, layers, register  # noqa: F401
