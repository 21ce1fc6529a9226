"""All registered queries of the engine and their SQL twins."""

from __future__ import annotations

from quern.plans import admin, content, ledgers, retrieval, search, sources, store

_PARTS = (retrieval, ledgers, content, admin, store, sources, search)

QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
