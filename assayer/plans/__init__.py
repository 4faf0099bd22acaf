"""Registered queries over the provided tables and their DuckDB counterparts."""

from assayer.plans import more as _more  # noqa: F401  registers its queries
from assayer.plans import records as _records  # noqa: F401  registers its queries
from assayer.plans import systems as _systems  # noqa: F401  registers its queries
from assayer.plans.curation import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
