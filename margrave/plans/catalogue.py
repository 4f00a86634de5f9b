"""All queries of the reference's operators, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import q_discretize, q_ingest, q_models, q_privacy, q_split

_PARTS = (q_ingest, q_split, q_discretize, q_privacy, q_models)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLES = {k: v for part in _PARTS for k, v in part.ORACLES.items()}
