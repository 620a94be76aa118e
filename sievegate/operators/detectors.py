"""Native detectors: each is a column expression from text to an array of findings."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import literal_starts, regex_hits
from ..policy import Policy

FINDING = "array<struct<start:bigint,end:bigint,rank:int,detector:string,confidence:double,evidence:string>>"

#: Phrases of the injection grammar and their severities.
HIGH_NEEDLES = ["ignore previous", "disregard previous", "ignore all prior", "ignore prior", "ignore the above", "disregard all", "forget all previous", "forget prior", "system:", "[inst]", "<|im_start|>"]
MEDIUM_NEEDLES = ["previous instructions", "prior instructions", "from now on", "do anything now", "new persona", "pretend to be", "pretend you are", "new instructions", "### instruction", "developer message", "you are now", "act as", "override"]
#: Letters of other alphabets that look like ASCII letters.
CONFUSABLES = "аеорсухіјмтнквΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
#: Characters without a glyph of their own.
INVISIBLE = "\\u00AD\\u180E\\u200B-\\u200D\\u2060\\u2061-\\u2064\\uFEFF\\u202A-\\u202E\\u2066-\\u2069\\uFFF9-\\uFFFB\\x{E0000}-\\x{E007F}"
#: Reserved tokens.
RESERVED = r"<\|(reserved_\d+|startoftext|endoftext|endofprompt|fim_prefix|fim_middle|fim_suffix|return|constrain|channel|start|end|message|call)\|>"
CREDIT_CARD = r"(?U)\b(?:\d[ -]*?){13,19}\b"
SSN = r"(?U)\b\d{3}-?\d{2}-?\d{4}\b"
API_KEY = r"(?U)\b(sk-[A-Za-z0-9]{16,}|ghp_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16})\b"
EMAIL = r"(?iU)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b"


def finding(start: Column, end: Column, rank_: Column | int, detector: str, confidence: float, evidence: Column) -> Column:
    r = F.lit(rank_) if isinstance(rank_, int) else rank_
    return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), r.cast("int").alias("rank"), F.lit(detector).alias("detector"), F.lit(confidence).cast("double").alias("confidence"), evidence.alias("evidence"))


def _none() -> Column:
    return F.array().cast(FINDING)


def _whole(text: Column, when: Column, rank_: int, detector: str, confidence: float, evidence: str) -> Column:
    return F.when(when, F.array(finding(F.lit(0), F.octet_length(text), rank_, detector, confidence, F.lit(evidence)))).otherwise(_none())


def injection(text: Column) -> Column:
    """Every non-overlapping hit of each phrase, in phrase order; a gate by any phrase keeps clean texts cheap."""
    low = F.lower(text)

    def hits(needle: str, r: int) -> Column:
        size = len(needle.encode())
        as_it_stands = lambda s: F.substring(text.cast("binary"), (s + 1).cast("int"), F.lit(size)).cast("string")
        return F.transform(literal_starts(low, needle), lambda s: finding(s, s + size, r, "injection_grammar", 0.88, as_it_stands(s)))

    found = [hits(n, r) for r, needles in ((3, HIGH_NEEDLES), (2, MEDIUM_NEEDLES)) for n in needles]
    any_ = low.rlike("|".join(re.escape(n) for n in HIGH_NEEDLES + MEDIUM_NEEDLES))
    return F.when(any_, F.concat(*found)).otherwise(_none())


def code_point(char: Column) -> Column:
    """Four hex digits at least."""
    digits_ = F.hex(F.ascii(char))
    return F.when(F.length(digits_) < 4, F.lpad(digits_, 4, "0")).otherwise(digits_)


def unicode_control(text: Column, action: str = "flag") -> Column:
    r = {"allow": 1, "strip": 1, "flag": 2, "deny": 4}[action]
    return F.transform(regex_hits(text, f"[{INVISIBLE}]"), lambda h: finding(h.start, h.end, r, "unicode_control", 0.92, F.concat(F.lit("unicode control U+"), code_point(h.text))))


def confusable(text: Column, action: str = "flag") -> Column:
    r = {"normalize": 1, "flag": 2, "deny": 4}[action]
    return _whole(text, text.rlike(f"[{CONFUSABLES}]") & text.rlike("[A-Za-z]"), r, "confusable", 0.86, "mixed-script confusables")


def token_firewall(text: Column, mode: str = "monitor") -> Column:
    r = {"monitor": 2, "enforce": 3, "strict": 4}[mode]
    return F.transform(regex_hits(text, RESERVED), lambda h: finding(h.start, h.end, r, "token_smuggling", 0.96, h.text))


def redact_sample(s: Column) -> Column:
    """At most six characters become stars, longer ones keep three at each end."""
    n = F.length(s)
    return F.when(n <= 6, F.repeat(F.lit("*"), F.greatest(n, F.lit(1)))).otherwise(F.concat(F.left(s, F.lit(3)), F.lit("…"), F.right(s, F.lit(3))))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def credit_card(text: Column) -> Column:
    hits = F.filter(regex_hits(text, CREDIT_CARD), lambda h: (F.length(digits(h.text)) >= 13) & F.call_function("luhn_check", digits(h.text)))
    return F.transform(hits, lambda h: finding(h.start, h.end, 4, "dlp_credit_card", 0.99, redact_sample(h.text)))


def ssn(text: Column) -> Column:
    return F.transform(regex_hits(text, SSN), lambda h: finding(h.start, h.end, 3, "dlp_ssn", 0.95, redact_sample(h.text)))


def api_key(text: Column) -> Column:
    return F.transform(regex_hits(text, API_KEY), lambda h: finding(h.start, h.end, 3, "dlp_api_key", 0.98, redact_sample(h.text)))


def email(text: Column, action: str = "flag") -> Column:
    if action == "off":
        return _none()
    r = {"redact": 1, "flag": 2, "deny": 3}[action]
    return F.transform(regex_hits(text, EMAIL), lambda h: finding(h.start, h.end, r, "dlp_email", 0.90, redact_sample(h.text)))


def custom(text: Column, patterns: tuple[str, ...]) -> Column:
    """Own patterns; those that do not compile are passed over."""

    def valid(pattern: str) -> bool:
        # both the engine that runs it and the one that reads it elsewhere must know the pattern
        try:
            re.compile(pattern)
            SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
        except (re.error, Py4JJavaError):
            return False
        return True

    def hits(pattern: str) -> Column:
        return F.transform(regex_hits(text, pattern), lambda h: finding(h.start, h.end, 2, "dlp_custom", 0.75, F.lit(pattern)))

    found = [hits(p) for p in patterns if valid(p)]
    return F.concat(*found) if found else _none()


def smuggling(text: Column) -> Column:
    """Invisible characters between two ASCII letters or digits, with these, and one finding for long base64-like runs."""
    bridge = F.transform(regex_hits(text, f"(?<=[A-Za-z0-9])[{INVISIBLE}](?=[A-Za-z0-9])"), lambda h: finding(h.start - 1, h.end + 1, 3, "token_smuggling", 0.84, F.lit("invisible bridge")))
    return F.concat(bridge, _whole(text, text.rlike("[A-Za-z0-9+/=]{32}"), 2, "token_smuggling", 0.68, "base64-like run"))


def native_findings(text: Column, policy: Policy) -> Column:
    """All findings that built-in functions can make, in run order. A detector that the policy turns off adds nothing to the plan."""
    s, d = policy.scan, policy.scan.dlp
    parts = []
    if s.injection:
        parts += [injection(text)]
        parts += [unicode_control(text, policy.intake.invisible), confusable(text, policy.intake.homoglyphs)]
    if s.token_firewall:
        parts.append(token_firewall(text, policy.mode))
    parts += [f(text) for f, on in ((credit_card, d.credit_cards), (ssn, d.ssn), (api_key, d.api_keys)) if on]
    parts.append(email(text, d.emails))
    if d.custom_patterns:
        parts.append(custom(text, d.custom_patterns))
    if s.smuggling:
        parts.append(smuggling(text))
    return F.concat(*parts)


