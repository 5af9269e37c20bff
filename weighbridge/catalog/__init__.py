"""Registered queries over the benchmark tables, each with its SQL counterpart."""

from __future__ import annotations

from weighbridge.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "load"]


def load() -> None:
    """Import every query module once."""
    from weighbridge.catalog import (  # noqa: F401
        answer_queries,
        audit_queries,
        inference_queries,
        judged_queries,
        policy_queries,
        ranking_queries,
        scoring_queries,
        snapshot_queries,
        source_queries,
        text_queries,
        triple_queries,
        vector_queries,
    )
