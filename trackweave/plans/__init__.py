"""Registered queries over the driver's tables, with their SQL: one for each operator or group of operators."""

from __future__ import annotations

from trackweave.plans import courts, detections, mask_queries, runs, tracks  # noqa: F401  they register their queries
from trackweave.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
