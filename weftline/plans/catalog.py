"""All queries of the library, by name."""

from __future__ import annotations

from weftline.plans import documents, facts, problems, rules, values  # noqa: F401  (they register their queries)
from weftline.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
