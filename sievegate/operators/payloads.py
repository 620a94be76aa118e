"""Detectors with state that built-in functions lack, in Arrow batches: encoded payloads and perplexity anomalies."""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.textmap import INVISIBLE_CLASS
from .detectors import CONFUSABLES, HIGH_NEEDLES, MEDIUM_NEEDLES

#: Where encoded text may hide; the group that holds it is the last one.
SPANS = [
    ("comment", r"(<!--[\s\S]*?-->)"),
    ("link-target", r"\]\(\s*([^)\s]{4,})\s*\)"),
    ("css-hidden", r'<[a-zA-Z][a-zA-Z0-9]*[^>]*style\s*=\s*"[^"]*(?:display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0|font-size\s*:\s*0)[^"]*"[^>]*>\s*([^<]{4,})'),
    ("html-hidden", r"<[a-zA-Z][a-zA-Z0-9]*[^>]*\shidden(?:\s[^>]*)?>\s*([^<]{4,})"),
    ("percent", r"((?:%[0-9A-Fa-f]{2}){4,})"),
    ("hex-esc", r"((?:\\x[0-9A-Fa-f]{2}){4,})"),
    ("entity", r"((?:&#x?[0-9A-Fa-f]{1,6};){3,})"),
    ("base64", r"([A-Za-z0-9+/=_-]{20,})"),
]
_COMPILED = [(name, re.compile(p)) for name, p in SPANS]
#: Java pattern of any of them, so that most rows never reach Python.
ANY_SPAN = r"<!--|\]\(|style\s*=|\shidden|(?:%[0-9A-Fa-f]{2}){4}|(?:\\x[0-9A-Fa-f]{2}){4}|(?:&#x?[0-9A-Fa-f]{1,6};){3}|[A-Za-z0-9+/=_-]{20}"
_GATE = re.compile(ANY_SPAN)
#: What a text with any of them has, besides runs of 20.
_HINTS = ("<!--", "](", "style", "hidden", "%", "\\x", "&#")
_RUNS = bytes(97 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-" else 32 for b in range(256))
_INVISIBLE = re.compile(f"[{INVISIBLE_CLASS}]")
MAX_SPANS, MAX_DECODED, MAX_DEPTH = 64, 32 << 10, 2

Hit = tuple[int, int, int, str, float, str]  # start, end (characters), rank, detector, confidence, evidence


def _base64(s: str) -> tuple[str, bytes] | None:
    """The first of four alphabets that gives back the text itself when its bytes are encoded again."""
    for label, alphabet, padded in (("base64", b"+/", True), ("base64url", b"-_", True), ("base64-nopad", b"+/", False), ("base64url-nopad", b"-_", False)):
        try:
            raw = base64.b64decode(s if padded else s + "=" * (-len(s) % 4), altchars=alphabet, validate=True)
        except (binascii.Error, ValueError):
            continue
        again = base64.b64encode(raw, altchars=alphabet).decode()
        if s == (again if padded else again.rstrip("=")):
            return label, raw
    return None


def _entities(s: str) -> str | None:
    out = []
    for x in re.findall(r"&#(x?)([0-9A-Fa-f]{1,6});", s):
        try:
            code = int(x[1], 16 if x[0] else 10)
        except ValueError:
            return None
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            return None
        out.append(chr(code))
    return "".join(out)


def _decode(scheme: str, s: str) -> list[tuple[str, str]]:
    """(label, plain text) of each way to read a span, in the order they are tried."""
    if scheme == "percent":
        return [(scheme, bytes.fromhex(s.replace("%", "")).decode("utf-8", "replace"))]
    if scheme == "hex-esc":
        return [(scheme, bytes.fromhex(s.replace("\\x", "")).decode("utf-8", "replace"))]
    if scheme == "entity":
        plain = _entities(s)
        return [] if plain is None else [(scheme, plain)]
    if scheme == "comment":
        return [(scheme, s[4:-3])]
    if scheme == "base64":
        found = _base64(s)
        out = [(found[0], found[1].decode("utf-8", "replace"))] if found else []
        if re.fullmatch(r"(?:[0-9A-Fa-f]{2})+", s):
            out.append(("hex", bytes.fromhex(s).decode("utf-8", "replace")))
        return out
    return [(scheme, s)]


def _printable(s: str) -> bool:
    good = sum(1 for c in s if c.isspace() or not (ord(c) < 32 or 127 <= ord(c) < 160))
    return bool(s) and good / len(s) >= 0.6


def _plain_hits(s: str, invisible: int, confusable: int) -> list[tuple[int, str, float, str]]:
    low = s.lower()
    out = [(r, "injection_grammar", 0.88, n) for r, ns in ((3, HIGH_NEEDLES), (2, MEDIUM_NEEDLES)) for n in ns for _ in range(low.count(n))]
    out += [(invisible, "unicode_control", 0.92, f"unicode control U+{ord(c):04X}") for c in _INVISIBLE.findall(s)]
    if any(c in CONFUSABLES for c in s) and re.search("[A-Za-z]", s):
        out.append((confusable, "confusable", 0.86, "mixed-script confusables"))
    return out


def may_hide(text: str) -> bool:
    """Whether a text has a span to decode."""
    return (any(h in text for h in _HINTS) or b"a" * 20 in text.encode("utf-8", "surrogatepass").translate(_RUNS)) and _GATE.search(text) is not None


def encoded_hits(text: str, depth: int = 0, invisible: int = 2, confusable: int = 2) -> list[Hit]:
    """Findings in text hidden by an encoding, at most two encodings deep; ranges are those of the outer span. ``invisible`` and ``confusable`` are the ranks of such characters."""
    if depth >= MAX_DEPTH or not may_hide(text):
        return []
    spans = [(m.start(m.lastindex or 0), m.end(m.lastindex or 0), label) for label, p in _COMPILED for m in p.finditer(text)]
    spans.sort(key=lambda x: (x[0], -x[1]))
    out: list[Hit] = []
    end = taken = 0
    for a, b, scheme in spans:
        if a < end:
            continue
        end = b
        if taken == MAX_SPANS:
            out.append((a, b, 1, "encoded_payload", 0.6, f"encoded span budget exhausted ({MAX_SPANS} examined)"))
            break
        taken += 1
        if scheme in ("css-hidden", "html-hidden"):
            out.append((a, b, 1, "encoded_payload", 0.7, f"{scheme} markup conceals body text"))
        for label, plain in _decode(scheme, text[a:b]):
            if len(plain.encode()) > MAX_DECODED:
                out.append((a, b, 1, "encoded_payload", 0.6, f"decoded({label}) payload exceeds {MAX_DECODED}-byte rescan cap"))
                break
            if not _printable(plain):
                continue
            inner = _plain_hits(plain, invisible, confusable) + [h[2:] for h in encoded_hits(plain, depth + 1, invisible, confusable)]
            out += [(a, b, max(r, 2), d, round(c * 0.95, 6), f"decoded({label}): {e}") for r, d, c, e in inner]
            break
    return out


_OUT = "start long, end long, rank int, detector string, confidence double, evidence string"


def _each(df: DataFrame, key: str, text: str, find: Callable[[str], list[Hit]], gate: str | None) -> DataFrame:
    """Findings of a Python detector as long rows; ``gate`` keeps rows without a chance out of Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for a, b, *rest in find(t):
                    for column, v in zip(rows, (k, len(t[:a].encode()), len(t[:b].encode()), *rest), strict=True):
                        column.append(v)
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(rows, kinds, strict=True)], names=[key, "start", "end", "rank", "detector", "confidence", "evidence"])

    some = df.where(F.col(text).isNotNull())
    some = some.where(F.col(text).rlike(gate)) if gate else some
    return some.select(key, F.col(text).cast("string").alias("_t")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {_OUT}")


def encoded_payloads(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return _each(df, key, text, encoded_hits, ANY_SPAN)


# ---- perplexity


def surprisals(text: str, order: int = 4) -> np.ndarray:
    """-ln p of each character under a model of the text itself, contexts of ``order`` characters, add-one smoothing."""
    k, n = min(max(order, 1), 16), len(text)
    chars = Counter(text)
    v = len(chars)
    context, pair = Counter(text[i - k : i] for i in range(k, n)), Counter(text[i - k : i + 1] for i in range(k, n))
    return np.array([-math.log((chars[c] + 1) / (n + v)) if i < k else -math.log((pair[text[i - k : i + 1]] + 1) / (context[text[i - k : i]] + v)) for i, c in enumerate(text)])


def perplexity_clusters(score: np.ndarray, scales: tuple[int, ...] = (16, 64, 256), z: float = 4.0, min_scales: int = 2, min_units: int = 128, most: int = 512, keep: int = 8) -> list[tuple[int, int, float]] | None:
    """(start, end, highest robust z) of clusters that stand out at several scales; None if the text is too short."""
    if len(score) < min_units:
        return None
    sums = np.concatenate(([0.0], np.cumsum(score)))
    flagged, left = [], most
    for w in sorted({s for s in scales if s >= 2}):
        starts = np.arange(0, len(score) - w + 1, max(1, w // 2))[:left]
        left -= len(starts)
        if not len(starts):
            continue
        mean = (sums[starts + w] - sums[starts]) / w
        middle = np.median(mean)
        mad = max(float(np.median(np.abs(mean - middle))), 1.1920929e-07)
        flagged += [(int(s), int(s) + w, w, 0.6745 * float(m - middle) / mad) for s, m in zip(starts, mean, strict=True) if 0.6745 * (m - middle) / mad >= z]
    flagged.sort(key=lambda f: (f[0], f[2]))
    clusters: list[list] = []
    for s, e, w, v in flagged:
        if clusters and s <= clusters[-1][1]:
            c = clusters[-1]
            c[1], c[2], c[3] = max(c[1], e), c[2] | {w}, max(c[3], v)
        else:
            clusters.append([s, e, {w}, v])
    found = [(s, e, v) for s, e, w, v in clusters if len(w) >= min_scales]
    return sorted(found, key=lambda c: -c[2])[:keep]


def perplexity_hits(text: str, scorer: Callable[[str], np.ndarray] = surprisals) -> list[Hit]:
    return [(s, e, 2, "perplexity_anomaly", min(1.0, v / 8), f"surprisal cluster z={v:.3f}") for s, e, v in perplexity_clusters(scorer(text)) or []]


def perplexity(df: DataFrame, key: str = "doc_id", text: str = "text", scorer: Callable[[str], np.ndarray] = surprisals) -> DataFrame:
    return _each(df, key, text, lambda t: perplexity_hits(t, scorer), None)


def mean_surprisal(text: Column, order: int = 4) -> Column:
    """Mean of ``surprisals`` of each text; 0 for an empty or null one."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([float(surprisals(t, order).mean()) if t else 0.0 for t in texts.to_pylist()], type=pa.float64())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(text)


def perplexity_reports(df: DataFrame, key: str = "doc_id", text: str = "text", scorer: Callable[[str], np.ndarray] | None = surprisals, name: str = "self") -> DataFrame:
    """Per row: key, status (evaluated, skipped if too short or without a scorer, failed), scorer, units and clusters. A scorer that raises fails its row and denies nothing."""
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("z", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status, units, found = [], [], []
            for t in batch.column(1).to_pylist():
                score, clusters = np.zeros(0), None
                try:
                    score = np.asarray(scorer(t or "")) if scorer else score
                    clusters = perplexity_clusters(score)
                    status.append("skipped" if clusters is None else "evaluated")
                except Exception:  # noqa: BLE001 - a port may raise anything
                    status.append("failed")
                units.append(len(score))
                found.append([dict(zip(kind.names, c, strict=True)) for c in clusters or []])
            columns = [pa.array(status, type=pa.string()), pa.array([name] * len(status), type=pa.string()), pa.array(units, type=pa.int64()), pa.array(found, type=pa.list_(kind))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "status", "scorer", "units", "clusters"])

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, status string, scorer string, units long, clusters array<struct<start:bigint,end:bigint,z:double>>"
    return df.select(key, F.col(text).cast("string").alias("_t")).mapInArrow(run, schema)
