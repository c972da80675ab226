"""Every registered query of the engine with its SQL."""

from __future__ import annotations

from rankyard.plans import campaign, ingestion, retrieval  # noqa: F401  they register their queries
from rankyard.plans.registry import ORACLES, QUERIES

FLAGSHIP = "bm25_topk_global"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
