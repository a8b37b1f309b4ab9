"""All named queries over the standard tables, each with its SQL."""

from __future__ import annotations

from . import aggregates, joins, sources, stateless, streams, windows  # noqa: F401  (they register what they hold)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
