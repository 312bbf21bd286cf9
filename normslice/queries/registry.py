"""All registered queries by name, with the equivalent SQL where there is one."""

from __future__ import annotations

from normslice.queries import connectors, documents, domains, primitives, reports  # noqa: F401  (they register on import)
from normslice.queries.logs import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
