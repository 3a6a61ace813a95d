"""The library's registered queries and the SQL that checks them."""

from __future__ import annotations

from . import cleaning, curves, large, pairs, selection, series, systems

_MODULES = (cleaning, curves, large, pairs, selection, series, systems)
QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
