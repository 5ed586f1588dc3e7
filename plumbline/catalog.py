"""All registered queries of the engine, without the training-data operators."""

from __future__ import annotations

from plumbline.plans import cost_queries, finding_queries, retrieval_queries, series_queries, source_queries, trace_queries  # noqa: F401
from plumbline.plans.registry import ORACLES, QUERIES


def flagship(spark, sf_dir):
    return QUERIES["q088_badge_board"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
