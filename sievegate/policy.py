"""Policy of a scan: frozen settings with defaults for every field, read from TOML in part or whole."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, is_dataclass


@dataclass(frozen=True)
class Dlp:
    credit_cards: bool = True
    ssn: bool = True
    api_keys: bool = True
    emails: str = "flag"  # flag, deny, redact, off
    custom_patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Perplexity:
    enabled: bool = False
    scales: tuple[int, ...] = (16, 64, 256)
    z_threshold: float = 4.0
    min_scales: int = 2
    min_units: int = 128
    max_windows: int = 512
    order: int = 4
    max_findings: int = 8


@dataclass(frozen=True)
class Terminal:
    enabled: bool = False
    max_sequences: int = 512


@dataclass(frozen=True)
class Scan:
    injection_threshold: float = 0.70
    injection: bool = True
    token_firewall: bool = True
    entropy: bool = True
    entropy_window: int = 64
    entropy_deviation: float = 3.0
    smuggling: bool = True
    encoded_payloads: bool = True
    rare_patterns: bool = True
    rare_order: int = 4
    rare_threshold: float = 0.02
    dlp: Dlp = field(default_factory=Dlp)
    perplexity: Perplexity = field(default_factory=Perplexity)
    terminal_escapes: Terminal = field(default_factory=Terminal)


@dataclass(frozen=True)
class Intake:
    normalization: str = "nfc"  # nfc, nfkc, none
    homoglyphs: str = "flag"  # normalize, flag, deny
    invisible: str = "flag"  # strip, flag, deny, allow
    max_input_bytes: int = 1 << 20


@dataclass(frozen=True)
class Emit:
    evidence_mode: str = "non-allow"  # or always
    max_evidence_findings: int = 64
    max_summary_chars: int = 256


@dataclass(frozen=True)
class Policy:
    mode: str = "monitor"  # monitor, enforce, strict
    taint: str = "accumulate"  # accumulate, reset, inherit
    suppress_cross_boundary: bool = True
    vocab: str = "r50k_base"
    intake: Intake = field(default_factory=Intake)
    scan: Scan = field(default_factory=Scan)
    emit: Emit = field(default_factory=Emit)


def _fill(kind: type, values: dict):
    known = {f.name: f for f in fields(kind)}
    out = {}
    for name, value in values.items():
        name = name.replace("-", "_")
        if name in known:  # unknown names and sections are passed over
            default = known[name].default_factory() if callable(known[name].default_factory) else None
            out[name] = _fill(type(default), value) if is_dataclass(default) else tuple(value) if isinstance(value, list) else value
    return kind(**out)


def load_policy(text: str) -> Policy:
    """A policy from TOML text; invalid TOML raises ValueError."""
    return _fill(Policy, tomllib.loads(text))


def load_patterns(text: str) -> tuple[str, ...]:
    """Custom patterns from TOML; anything unreadable gives none."""
    try:
        found = tomllib.loads(text).get("patterns", [])
    except tomllib.TOMLDecodeError:
        return ()
    return tuple(p for p in found if isinstance(p, str))
