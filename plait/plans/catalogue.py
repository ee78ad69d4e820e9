"""All queries of the engine."""

from . import elements, formats, graphs, groups, relational, statistics  # noqa: F401  each registers its queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
