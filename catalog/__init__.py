"""Registered queries: each operator run on whole tables, beside the SQL that must agree with it."""

from catalog.registry import ORACLE, QUERIES
from catalog import (  # noqa: F401  (importing a module registers its queries)
    files, frames, lookups, metrics, post, profiles, scaling, scoring, splits, stats)

__all__ = ["ORACLE", "QUERIES"]
