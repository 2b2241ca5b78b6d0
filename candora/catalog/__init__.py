"""Registered queries over the given tables, each with the SQL that defines its result."""

from __future__ import annotations

from candora.catalog import attribution, behavior, evaluation, exploration, fitted, learning, preparation, text

_AREAS = (preparation, behavior, text, learning, fitted, evaluation, attribution, exploration)

QUERIES = {name: query for area in _AREAS for name, query in area.QUERIES.items()}
ORACLES = {name: sql for area in _AREAS for name, sql in area.ORACLES.items()}
