"""From findings to assessment, verdict, reasons, evidence, techniques and receipts; no shuffle, as findings stay with their row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import short_batches
from ..functions.names import free_name
from ..functions.severity import name_of
from ..policy import Policy
from .bank import report_column

#: Detector -> techniques and mitigations.
TECHNIQUES = {
    "injection_grammar": ["AML.T0051", "AML.T0054"],
    "unicode_control": ["AML.T0068", "T1027"],
    "confusable": ["AML.T0068", "T1027"],
    "token_smuggling": ["AML.T0068", "T1027"],
    "merge_boundary": ["AML.T0068", "T1027"],
    "rare_pattern": ["AML.T0068", "T1027"],
    "entropy_spike": ["AML.T0068", "T1027"],
    "encoded_payload": ["AML.T0068", "T1027", "T1140"],
    "dlp_credit_card": ["AML.T0024"],
    "dlp_ssn": ["AML.T0024"],
    "dlp_api_key": ["AML.T0024"],
    "dlp_email": ["AML.T0024"],
    "dlp_custom": ["AML.T0024"],
    "cross_modal": ["AML.T0051.001"],
    "subliminal_audio": ["AML.T0068", "T1027"],
    "audio_steganography": ["AML.T0068", "T1027"],
    "fingerprint_mismatch": ["AML.T0010", "T1553"],
    "consistency_shift": ["AML.T0010", "T1553"],
    "slow_rate_injection": ["AML.T0051", "T0080"],
    "perplexity_anomaly": ["AML.T0054"],
    "terminal_escape": ["AML.T0068", "T1059"],
    "schema_violation": [],
}
MITIGATIONS = {
    "injection_grammar": ["AML.M0015", "AML.M0020"],
    "unicode_control": ["AML.M0015"],
    "confusable": ["AML.M0015"],
    "token_smuggling": ["AML.M0015"],
    "merge_boundary": ["AML.M0015"],
    "rare_pattern": ["AML.M0015"],
    "entropy_spike": ["AML.M0015"],
    "encoded_payload": ["AML.M0015"],
    "dlp_credit_card": ["AML.M0015", "AML.M0020"],
    "dlp_ssn": ["AML.M0015", "AML.M0020"],
    "dlp_api_key": ["AML.M0015", "AML.M0020"],
    "dlp_email": ["AML.M0015", "AML.M0020"],
    "dlp_custom": ["AML.M0015", "AML.M0020"],
    "cross_modal": ["AML.M0009", "AML.M0015", "AML.M0020"],
    "subliminal_audio": ["AML.M0015"],
    "audio_steganography": ["AML.M0015"],
    "fingerprint_mismatch": ["AML.M0014"],
    "consistency_shift": ["AML.M0014"],
    "slow_rate_injection": ["AML.M0015", "AML.M0024"],
    "perplexity_anomaly": ["AML.M0015", "AML.M0020"],
    "terminal_escape": ["AML.M0015", "AML.M0020"],
    "schema_violation": [],
}


def max_rank(findings: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(findings, lambda f: f.rank)), F.lit(0))


def threat_count(findings: Column) -> Column:
    return F.size(F.filter(findings, lambda f: f.rank > 0)).cast("long")


def injection_score(findings: Column) -> Column:
    total = F.aggregate(findings, F.lit(0.0), lambda a, f: a + f.rank / F.lit(4.0) * (0.25 + F.greatest(f.confidence, F.lit(0.1))))
    return F.round(F.least(F.lit(1.0), total), 6)


def verdict(rank_: Column, mode: str | Column) -> Column:
    """allow, flag or deny by severity and mode."""
    m = F.lit(mode) if isinstance(mode, str) else mode
    return (
        F.when(rank_ >= 4, "deny")
        .when(rank_ == 3, F.when(m == "monitor", "flag").otherwise("deny"))
        .when(rank_ == 2, F.when(m == "strict", "deny").otherwise("flag"))
        .when(rank_ == 1, "flag")
        .otherwise("allow")
    )


def has(findings: Column, *detectors: str) -> Column:
    return F.exists(findings, lambda f: f.detector.isin(*detectors))


def flag_reasons(findings: Column, anomalies: Column | None = None) -> Column:
    """Reasons of a flag in fixed order; unicode abuse is what remains."""
    some = [
        F.when(has(findings, "injection_grammar") | F.exists(findings, lambda f: F.contains(f.evidence, F.lit("instruction"))), "InjectionPattern"),
        F.when(has(findings, "dlp_credit_card", "dlp_ssn", "dlp_api_key", "dlp_email", "dlp_custom"), "DlpFinding"),
        F.when((anomalies if anomalies is not None else F.lit(0)) > 0, "EntropyAnomaly"),
        F.when(has(findings, "token_smuggling"), "Smuggling"),
        F.when(has(findings, "perplexity_anomaly"), "PerplexityAnomaly"),
        F.when(has(findings, "terminal_escape"), "TerminalEscape"),
    ]
    found = F.array_compact(F.array(*some))
    return F.when((F.size(found) == 0) & (threat_count(findings) > 0), F.array(F.lit("UnicodeAbuse"))).otherwise(found)


def deny_reason(rank_: Column) -> Column:
    return F.when(rank_ >= 4, "CriticalFinding").otherwise("PolicyViolation")


def summary(verdict_: Column, findings: Column, limit: int = 64, chars: int = 256) -> Column:
    listed = F.array_join(F.transform(F.slice(findings, 1, limit), lambda f: name_of(f.rank)), ", ")
    text = F.concat(F.lit("verdict="), verdict_, F.lit("; findings=["), listed, F.lit("]"), F.when(F.size(findings) > limit, "; truncated=true").otherwise(""))
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars - 1), F.lit("…"))).otherwise(text)


def evidence_id(summary_: Column, token_count: Column, as_of_ms: Column, prefix: str = "evidence-") -> Column:
    """sha384 of summary, count and time (little-endian), its first 8 bytes."""
    le = lambda c: F.unhex(F.regexp_replace(F.lpad(F.hex(c.cast("long")), 16, "0"), "(..)(..)(..)(..)(..)(..)(..)(..)", "$8$7$6$5$4$3$2$1"))
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.encode(summary_, "UTF-8"), le(token_count), le(as_of_ms)), 384), 1, 16))


def digests(raw: Column, canonical: Column, bits: int = 384) -> tuple[Column, Column]:
    return F.sha2(raw, bits), F.sha2(canonical, bits)


def receipt_message(raw: Column, canonical: Column, digest: str, normalization: str, vocab: str, tokens: Column, prefix: str = "receipt-v2") -> Column:
    return F.concat(F.lit(f"{prefix}|raw="), raw, F.lit("|canonical="), canonical, F.lit(f"|digest={digest}|norm={normalization}|vocab={vocab}|tokens="), tokens.cast("string"))


def attestation(subject: Column, digest: Column, predicate_type: str, predicate: Column) -> tuple[Column, Column]:
    """In-toto statement JSON and its DSSE pre-authentication encoding."""
    statement = F.to_json(
        F.struct(
            F.lit("https://in-toto.io/Statement/v1").alias("_type"),
            F.array(F.struct(subject.alias("name"), F.struct(digest.alias("sha384")).alias("digest"))).alias("subject"),
            F.lit(predicate_type).alias("predicateType"),
            predicate.alias("predicate"),
        )
    )
    kind = "application/vnd.in-toto+json"
    pae = F.concat(F.lit(f"DSSEv1 {len(kind)} {kind} "), F.octet_length(statement).cast("string"), F.lit(" "), statement)
    return statement, pae


def techniques(findings: Column, table: dict[str, list[str]] = TECHNIQUES, rare: Column | None = None) -> Column:
    """Sorted distinct ids of all detectors that fired; what was found in decoded text counts for encoded payloads too, and ``rare`` n-grams for theirs."""
    of = F.create_map(*[x for d, ids in table.items() for x in (F.lit(d), F.array(*map(F.lit, ids)).cast("array<string>"))])
    none = F.array().cast("array<string>")
    ids = F.flatten(F.transform(findings, lambda f: F.coalesce(F.element_at(of, f.detector), none)))
    ids = F.concat(ids, F.when(F.exists(findings, lambda f: F.startswith(f.evidence, F.lit("decoded("))), F.element_at(of, F.lit("encoded_payload"))).otherwise(none))
    if rare is not None:
        ids = F.concat(ids, F.when(rare > 0, F.element_at(of, F.lit("rare_pattern"))).otherwise(none))
    return F.array_sort(F.array_distinct(ids))


def mitigations(findings: Column, rare: Column | None = None) -> Column:
    return techniques(findings, MITIGATIONS, rare)


def exit_code(verdict_: Column, fail_on: str = "deny") -> Column:
    return F.when((verdict_ == "deny") & F.lit(fail_on in ("deny", "flag")), 2).when((verdict_ == "flag") & F.lit(fail_on == "flag"), 1).otherwise(0)


def rank_in_mode(findings: Column, mode: str, rare: Column | None = None) -> Column:
    """Highest severity if the scan ran in ``mode``, on which the severity of reserved tokens depends."""
    firewall = {"monitor": 2, "enforce": 3, "strict": 4}[mode]
    top = F.array_max(F.transform(findings, lambda f: F.when((f.detector == "token_smuggling") & (f.confidence == 0.96), firewall).otherwise(f.rank)))
    return F.greatest(F.coalesce(top, F.lit(0)), F.when(rare > 0, 1).otherwise(0) if rare is not None else F.lit(0))


def absorb(df: DataFrame, more: Column, findings: str = "findings") -> DataFrame:
    """Findings of the merge stage appended to those of a scan: severity and number follow, the injection score stays."""
    all_ = F.concat(F.col(findings), more)
    return df.withColumns({findings: all_, "max_rank": F.greatest(F.col("max_rank"), max_rank(more)), "threat_count": F.col("threat_count") + threat_count(more)})


def scan(df: DataFrame, policy: Policy | None = None, text: str = "text", spans: bool = False) -> DataFrame:
    """``df`` with status, findings, rare, entropy, max_rank, threat_count, injection_score, verdict and reasons, by all detectors of the policy.

    Texts above the size gate have the status ``input_too_large`` and no
    findings; a null text is empty. One Arrow pass over the text column, no
    shuffle. Rare n-grams count in all results; they are among the findings with
    ``spans`` only (hundreds for an ordinary text), else ``rare`` has their
    number and highest confidence.
    """
    policy = policy or Policy()
    short_batches(df.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    ok = F.octet_length(body) <= policy.intake.max_input_bytes
    out = df.withColumn("status", F.when(ok, "ok").otherwise("input_too_large"))
    report = free_name(df, "_report")
    out = out.withColumn(report, report_column(F.when(ok, body).otherwise(F.lit("")), policy, spans))
    r = F.col(report)
    out = out.withColumns({
        "findings": r["findings"],
        "rare": F.struct(r["rare"].alias("count"), F.round(r["rare_confidence"], 6).alias("confidence")),
        "entropy": F.struct(F.lit(policy.scan.entropy_window).alias("window"), *[r[c].alias(c) for c in ("baseline", "average", "peak")], r["anomalies"].alias("anomalies")),
        "injection_score": F.round(r["score"], 6),
    })
    f, many = F.col("findings"), F.lit(0).cast("long") if spans else F.col("rare")["count"]
    out = out.withColumns({"max_rank": F.greatest(max_rank(f), F.when(many > 0, 1).otherwise(0)), "threat_count": threat_count(f) + many})
    reasons = flag_reasons(f, F.col("entropy")["anomalies"])
    reasons = F.when((F.size(reasons) == 0) & (F.col("threat_count") > 0), F.array(F.lit("UnicodeAbuse"))).otherwise(reasons)
    return out.withColumns({"verdict": verdict(F.col("max_rank"), policy.mode), "reasons": reasons}).drop(report)


def gives_evidence(verdict_: Column, policy: Policy | None = None) -> Column:
    """Whether a scanned row gives evidence: its verdict is other than allow, or the mode is ``always``."""
    return F.lit(True) if (policy or Policy()).emit.evidence_mode == "always" else verdict_ != "allow"


def assessed(df: DataFrame, policy: Policy | None = None, key: str = "doc_id", as_of_ms: int = 0) -> DataFrame:
    """The evidence of scanned rows: those with a verdict other than allow, or all in the mode ``always``; the first findings and a summary of bounded length."""
    policy = policy or Policy()
    rows = df.where(gives_evidence(F.col("verdict"), policy))
    kept = F.slice("findings", 1, policy.emit.max_evidence_findings)
    text = summary(F.col("verdict"), F.col("findings"), policy.emit.max_evidence_findings, policy.emit.max_summary_chars)
    rows = rows.withColumns({"summary": text, "kept": kept, "truncated": F.size("findings") > policy.emit.max_evidence_findings})
    return rows.select(key, "verdict", F.col("kept").alias("findings"), "truncated", "summary", evidence_id(F.col("summary"), F.lit(0), F.lit(as_of_ms)).alias("evidence_id"), F.lit(as_of_ms).cast("long").alias("timestamp_unix_ms"))
