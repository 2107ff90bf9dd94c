"""Registered queries: carrier views on the given tables, Spark queries, and oracle SQL."""

from gridspark.catalog import checks, files, formats, physics, regional, roundtrips, runs, space, times  # noqa: F401
from gridspark.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
