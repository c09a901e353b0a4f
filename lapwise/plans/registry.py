"""All queries of the library with their DuckDB oracles, by name."""

from __future__ import annotations

from lapwise.plans import asking, basics, checking, composites, estimating, explaining, joining, learning, marts, states, storing, surviving, validating, windowing
from lapwise.plans.registration import ORACLES, QUERIES

MODULES = (basics, joining, windowing, estimating, surviving, checking, storing, marts, composites, explaining, states, learning, validating, asking)

__all__ = ["MODULES", "ORACLES", "QUERIES"]
