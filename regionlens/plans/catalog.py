"""All registered queries. Importing the query modules fills the registry."""

from __future__ import annotations

from regionlens.plans import demand, display, marts, regions, supply  # noqa: F401
from regionlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
