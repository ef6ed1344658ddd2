"""All queries outside the training-data subpackage, with their SQL."""

from __future__ import annotations

from tidemark.plans import measures, records, shaping

_MODULES = [shaping, measures, records]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
