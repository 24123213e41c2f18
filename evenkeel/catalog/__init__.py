"""The registered queries: each a Spark function with the SQL that gives the same rows."""

from . import antidotes, completed, description, experiments, fairness, files, fitted, preparation, ranking  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
