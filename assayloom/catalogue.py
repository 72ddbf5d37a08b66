"""All queries and their DuckDB counterparts, by name."""

from __future__ import annotations

import assayloom.queries_core
import assayloom.queries_models  # noqa: F401  entering the queries is what the imports are for
from assayloom.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
