"""Severity lattice and trust order as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ["none", "low", "medium", "high", "critical"]
TRUST = ["untrusted", "bounded", "trusted", "privileged"]
#: Trust that a provenance has by default.
DEFAULT_TRUST = {"system": 3, "tool": 2, "generated": 2, "retrieval": 1, "mcp_context": 1, "user": 0, "mcp_tool": 0, "unknown": 0}


def rank(name: str) -> int:
    return SEVERITIES.index(name)


def name_of(column: Column, names: list[str] = SEVERITIES) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), column.cast("int") + 1)


def default_trust(provenance: Column) -> Column:
    """Rank 0-3; unknown provenances are untrusted."""
    out = F.lit(0)
    for p, r in DEFAULT_TRUST.items():
        out = F.when(provenance == p, r).otherwise(out)
    return out


def band(score: Column, cuts: list[float], names: list[str]) -> Column:
    """The name of the band that a score falls in; a score at a cut belongs to the upper band."""
    out = F.lit(names[0])
    for cut, name in zip(cuts, names[1:], strict=True):
        out = F.when(score >= cut, name).otherwise(out)
    return out
