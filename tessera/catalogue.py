"""Names of the library's queries, with their DuckDB counterparts."""

from __future__ import annotations

from tessera.plans import fit_oracles, oracles
from tessera.plans.queries import QUERIES

FLAGSHIP = "kde_rate_map"
ORACLES = oracles.ORACLES | fit_oracles.ORACLES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
