"""All queries of the engine by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from tessera.plans import masks, relational

QUERIES = relational.QUERIES | masks.QUERIES
ORACLES = relational.ORACLES | masks.ORACLES
