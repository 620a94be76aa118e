"""All queries of the engine and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from .plans import decisions, gates, scan, streams

QUERIES: dict = {**scan.QUERIES, **decisions.QUERIES, **gates.QUERIES, **streams.QUERIES}
ORACLES: dict = {**scan.ORACLES, **decisions.ORACLES, **gates.ORACLES, **streams.ORACLES}
