"""The registered queries of the catalog operators, and the SQL that gives the same rows."""

from __future__ import annotations

from catalith.plans import catalog, search, vectors

QUERIES = catalog.QUERIES | search.QUERIES | vectors.QUERIES
ORACLES: dict[str, str] = catalog.ORACLES | search.ORACLES | vectors.ORACLES
