"""The registered queries of the engine."""

from glintsieve.queries import findings, flows, functions, inputs, outputs, relations  # noqa: F401
from glintsieve.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
