"""Queries over the generated tables, one or more for each operator."""
from mediaframe.queries import analysis, catalogue, timeline  # noqa: F401
from mediaframe.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
