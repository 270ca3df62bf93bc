"""Name -> query, and name -> the same query in ANSI SQL."""

from __future__ import annotations

from . import boxes, counts, distributions, files, ranking, sequences  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
