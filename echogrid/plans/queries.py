"""All registered queries."""

from __future__ import annotations

from . import queries_core, queries_signal
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "queries_core", "queries_signal"]
