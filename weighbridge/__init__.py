"""Spark operators for judged-passage evaluation: prepare, judge, rank, cite, measure."""

from weighbridge.settings import LIMITS, Limits

__all__ = ["LIMITS", "Limits"]
