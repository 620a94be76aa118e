"""The detectors in run order over one text, in one Arrow pass.

Order: injection grammar, unicode control and confusables, token firewall,
personal data, entropy, smuggling, encoded payloads, rare n-grams, perplexity,
terminal sequences. Rare n-grams are many (hundreds in an ordinary text), so by
default they are kept as a number, a highest confidence and a share of the
score; as findings only if asked for.

Ranges are raw bytes and cover whole clusters, but for confusables, base64-like
runs, rare n-grams, perplexity and terminal sequences, whose ranges are those
of the canonical text.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.batches import of_lists
from ..functions.textmap import INVISIBLE_CLASS, TextMap, byte_offsets, code_points
from ..policy import Policy
from .detectors import CONFUSABLES, HIGH_NEEDLES, MEDIUM_NEEDLES, RESERVED
from .ngrams import entropy_profile, rare_of
from .payloads import encoded_hits, perplexity_hits
from .terminal import terminal_hits

RESULT = (
    "findings array<struct<start:bigint,end:bigint,rank:int,detector:string,confidence:double,evidence:string>>, baseline double, average double, peak double, anomalies bigint, "
    "rare bigint, rare_confidence double, score double, canonical string"
)
_KIND = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("rank", pa.int32()), ("detector", pa.string()), ("confidence", pa.float64()), ("evidence", pa.string())])
_NEEDLES = [(n, r) for r, ns in ((3, HIGH_NEEDLES), (2, MEDIUM_NEEDLES)) for n in ns]
_INV = re.compile(f"[{INVISIBLE_CLASS}]")
_CONFUSED = re.compile(f"[{CONFUSABLES}]")
_LETTER = re.compile("[A-Za-z]")
_FIREWALL = re.compile(RESERVED)
_DIGITS = re.compile(r"(?:\d[ -]*){13}")
_CARD = re.compile(r"\b(?:\d[ -]*?){13,19}\b")
_SSN = re.compile(r"\b\d{3}-?\d{2}-?\d{4}\b")
_KEY = re.compile(r"\b(sk-[A-Za-z0-9]{16,}|ghp_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16})\b")
_MAIL = re.compile(r"\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b", re.IGNORECASE)
_BRIDGE = re.compile(f"(?<=[A-Za-z0-9])[{INVISIBLE_CLASS}](?=[A-Za-z0-9])")
#: Bytes by what they are, and what a text that has a match must hold.
_DIGITS_ONLY = bytes(48 if 48 <= b < 58 else b if b in b" -" else 46 for b in range(256))
_CARD_HINT, _SSN_HINTS = b"0" * 13, (b"000-00-0000", b"00000-0000", b"000-000000", b"0" * 9)
_RUNS, _RUN_HINT = bytes(97 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=" else 32 for b in range(256)), b"a" * 32
#: The first decimal digit beyond ASCII.
_OTHER_DIGITS = 0x660
_RANK = {"allow": 1, "strip": 1, "normalize": 1, "redact": 1, "flag": 2, "deny": 4}


def redacted(s: str) -> str:
    return "*" * max(1, len(s)) if len(s) <= 6 else f"{s[:3]}…{s[-3:]}"


def luhn(s: str) -> bool:
    digits = [int(c) for c in s if c in "0123456789"]
    return len(digits) >= 13 and sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


@dataclass
class Report:
    """Findings (start, end, rank, detector, confidence, evidence), entropy profile, and the rare n-grams in short."""

    findings: list[tuple] = field(default_factory=list)
    profile: tuple = (0.0, 0.0, 0.0, 0)
    rare: int = 0
    rare_confidence: float = 0.0
    rare_score: float = 0.0

    def score(self) -> float:
        return min(1.0, sum(f[2] / 4 * (0.25 + max(f[4], 0.1)) for f in self.findings) + self.rare_score)


def injection_hits(text: str) -> list[tuple]:
    """(start, end, rank, evidence) in characters: each phrase on its own, without overlaps; evidence is the text as it stands."""
    low, out = text.lower(), []
    places = None
    if len(low) != len(text):  # characters whose lower case has another length
        places = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text]).tolist() + [len(text)]
    for needle, rank in _NEEDLES:
        at = low.find(needle)
        while at >= 0:
            a, b = at, at + len(needle)
            if places:
                a, b = places[a], places[b]
            out.append((a, b, rank, text[a:b]))
            at = low.find(needle, at + len(needle))
    return out


class Bank:
    def __init__(self, policy: Policy, spans: bool = False) -> None:
        """``spans`` gives rare n-grams as findings too."""
        self.policy, self.spans = policy, spans
        self.custom = []
        for pattern in policy.scan.dlp.custom_patterns:
            try:
                self.custom.append((pattern, re.compile(pattern)))
            except re.error:
                continue  # patterns that do not compile are passed over

    def scan(self, raw: str) -> tuple[Report, TextMap]:
        p, s = self.policy, self.policy.scan
        m = TextMap(raw, p.intake.normalization, p.intake.invisible == "strip")
        text, ascii_ = m.text, m.text.isascii()
        report = Report()
        out = report.findings
        raw8, chars = text.encode(), code_points(text)
        whole = len(raw8)
        offsets = functools.cache(lambda: byte_offsets(chars))
        at = (lambda i: i) if ascii_ else (lambda i: int(offsets()[i]))
        # other digits are left to the patterns
        plain = ascii_ or chars.max() < _OTHER_DIGITS
        digits = raw8.translate(_DIGITS_ONLY) if plain and (s.dlp.credit_cards or s.dlp.ssn) else b""

        def add(a: int, b: int, *rest, mapped: bool = True) -> None:
            out.append(((*m.source(at(a), at(b)), *rest) if mapped else (at(a), at(b), *rest)))

        if s.injection:
            for a, b, rank, evidence in injection_hits(text):
                add(a, b, rank, "injection_grammar", 0.88, evidence)
            if not ascii_:
                for h in _INV.finditer(text):
                    add(h.start(), h.end(), _RANK[p.intake.invisible], "unicode_control", 0.92, f"unicode control U+{ord(h.group()):04X}")
                if _CONFUSED.search(text) and _LETTER.search(text):
                    out.append((0, whole, _RANK[p.intake.homoglyphs], "confusable", 0.86, "mixed-script confusables"))
        if s.token_firewall and "<|" in text:
            for h in _FIREWALL.finditer(text):
                add(h.start(), h.end(), {"monitor": 2, "enforce": 3, "strict": 4}[p.mode], "token_smuggling", 0.96, h.group())
        if s.dlp.credit_cards and (_CARD_HINT in digits.translate(None, b" -") if plain else _DIGITS.search(text)):
            for h in _CARD.finditer(text):
                if luhn(h.group()):
                    add(h.start(), h.end(), 4, "dlp_credit_card", 0.99, redacted(h.group()))
        if s.dlp.ssn and (not plain or any(h in digits for h in _SSN_HINTS)):
            for h in _SSN.finditer(text):
                add(h.start(), h.end(), 3, "dlp_ssn", 0.95, redacted(h.group()))
        if s.dlp.api_keys and any(k in text for k in ("sk-", "ghp_", "AKIA")):
            for h in _KEY.finditer(text):
                add(h.start(), h.end(), 3, "dlp_api_key", 0.98, redacted(h.group()))
        if s.dlp.emails != "off" and "@" in text:
            for h in _MAIL.finditer(text):
                add(h.start(), h.end(), {"redact": 1, "flag": 2, "deny": 3}[s.dlp.emails], "dlp_email", 0.90, redacted(h.group()))
        for pattern, compiled in self.custom:
            for h in compiled.finditer(text):
                add(h.start(), h.end(), 2, "dlp_custom", 0.75, pattern)
        if s.entropy:
            base, average, peak, many, odd = entropy_profile(raw8, max(1, s.entropy_window), s.entropy_deviation)
            report.profile = (base, average, peak, many)
            for start, h in odd:
                out.append((*m.source(start, start + s.entropy_window), 3 if h > base else 2, "entropy_spike", 0.72, f"entropy spike {h:.2f} vs {base:.2f}"))
        if s.smuggling:
            if not ascii_:
                for h in _BRIDGE.finditer(text):
                    add(h.start() - 1, h.end() + 1, 3, "token_smuggling", 0.84, "invisible bridge")
            if _RUN_HINT in raw8.translate(_RUNS):
                out.append((0, whole, 2, "token_smuggling", 0.68, "base64-like run"))
        if s.encoded_payloads:
            for a, b, *rest in encoded_hits(text, 0, _RANK[p.intake.invisible], _RANK[p.intake.homoglyphs]):
                add(a, b, *rest)
        if s.rare_patterns:
            grams = rare_of(text, s.rare_order, s.rare_threshold, chars)
            if len(grams.share):
                confidence = 1 - grams.share
                report.rare, report.rare_confidence = len(confidence), float(confidence.max())
                if self.spans:
                    for i in np.lexsort((-confidence, grams.first)):
                        a = int(grams.first[i])
                        add(a, a + s.rare_order, 1, "rare_pattern", float(confidence[i]), f'rare n-gram "{text[a : a + s.rare_order]}" (freq={grams.share[i]:.6f}, count={int(grams.count[i])})', mapped=False)
                else:
                    report.rare_score = float(0.25 * (0.25 + np.maximum(confidence, 0.1)).sum())
        if s.perplexity.enabled:
            for a, b, *rest in perplexity_hits(text):
                add(a, b, *rest, mapped=False)
        if s.terminal_escapes.enabled:
            out += terminal_hits(raw8, s.terminal_escapes.max_sequences)
        return report, m


def report_column(text: Column, policy: Policy, spans: bool = False, canonical: bool = False) -> Column:
    """A struct of ``RESULT`` for each text; a null text is empty."""

    def run(texts: pa.Array) -> pa.Array:
        bank = Bank(policy, spans)
        found, rows = [], []
        for t in texts:
            report, m = bank.scan(t.as_py() or "")
            found.append(report.findings)
            rows.append((*report.profile, report.rare, report.rare_confidence, report.score(), m.text if canonical else None))
        columns = list(zip(*rows, strict=True)) or [()] * 8
        kinds = (pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string())
        names = ("baseline", "average", "peak", "anomalies", "rare", "rare_confidence", "score", "canonical")
        flat = [pa.array([f[i] for one in found for f in one], type=_KIND[i].type) for i in range(len(_KIND))]
        listed = of_lists(_KIND, [len(one) for one in found], pa.StructArray.from_arrays(flat, fields=list(_KIND)))
        return pa.StructArray.from_arrays([listed, *(pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True))], names=["findings", *names])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    # not deterministic to the optimizer, which else scans once for a filter on the result, before rows are dealt, and once more for the result
    return F.arrow_udf(run, RESULT).asNondeterministic()(F.coalesce(text, F.lit("")))
