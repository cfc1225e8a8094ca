"""All core queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from . import graph, ingest, links, problems, search


def _modules():
    return [graph, links, search, ingest, problems]


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _modules() for k, v in m.ORACLE.items()}
