"""All queries of the core and the SQL that states the same result."""

from __future__ import annotations

from folioflow.plans import catalogue, evaluate, index, retrieve, texts
from folioflow.plans.register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalogue", "evaluate", "index", "retrieve", "texts"]
