"""Sentinel scores, tool-response gate, cross-modal fusion: decisions as column expressions and grouped folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import default_trust

#: Sentinel phrases by class.
SENTINEL = {
    "injection": ["ignore previous", "system prompt", "developer message", "prompt injection", "act as", "follow these steps", "roleplay", "override"],
    "jailbreak": ["jailbreak", "dan", "developer mode", "do anything now", "unfiltered", "disable safety", "bypass"],
    "dlp": ["sk-", "ghp_", "akia", "ssn", "credit card", "@"],
    "safety": ["weapon", "explosive", "malware", "phishing", "self-harm", "bomb", "evade detection"],
    "adversarial": ["base64", "hex", "obfuscate", "unicode", "​", "‮", "ignore previous"],
}
#: Phrases by modality and their severity ranks.
MODALITY = {
    "vision": {"text in image": 3, "adversarial patch": 4, "stego": 3, "ocr": 2},
    "audio": {"ultrasonic": 4, "hidden speech": 3, "command": 2, "transcript": 1},
    "video": {"single frame": 4, "frame 1": 3, "subtitle injection": 3},
    "code": {"polyglot": 3, "comment injection": 3, "encoding exploit": 4, "ignore previous": 4},
    "document": {"hidden layer": 3, "white on white": 2, "ocr": 1, "cross modal": 3},
}


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def clip(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


# ---- sentinel


def share_of(text: Column, needles: list[str]) -> Column:
    hit = [F.when(F.contains(text, F.lit(n)), 1).otherwise(0) for n in needles]
    return sum(hit[1:], hit[0]) / F.lit(float(len(needles)))


def sentinel(text: Column, max_rank: Column, has_dlp: Column) -> dict[str, Column]:
    """Scores by class, threat and action; severity and sensitive data raise their classes."""
    low = ascii_lower(text)
    s = {k: share_of(low, v) for k, v in SENTINEL.items()}
    s["adversarial"] = clip(s["adversarial"] + F.when(max_rank >= 2, 0.15).otherwise(0.0))
    s["dlp"] = clip(s["dlp"] + F.when(has_dlp, 0.20).otherwise(0.0))
    i, j = s["injection"] > 0, s["jailbreak"] > 0
    bump = F.when(i & j, 0.20).when(i | j, 0.10).otherwise(0.0)
    s["threat"] = clip(0.25 * s["injection"] + 0.25 * s["jailbreak"] + 0.15 * s["dlp"] + 0.20 * s["safety"] + 0.15 * s["adversarial"] + bump)
    return {k: F.round(v, 6) for k, v in s.items()}


def sentinel_action(threat: Column, safety: Column) -> Column:
    return F.when((threat >= 0.75) | (safety >= 0.85), "deny").when(threat >= 0.45, "flag").when(threat >= 0.20, "escalate").otherwise("allow")


def sentinel_confidence(threat: Column) -> Column:
    return F.round(clip(1 - F.abs(threat - 0.5)), 6)


def compose(rank: Column, action: Column, threat: Column) -> Column:
    """Verdict of kernel and sentinel together; the first matching rule counts."""
    return (
        F.when(rank >= 4, "deny")
        .when((rank == 3) & ((action == "deny") | (threat >= 0.70)), "deny")
        .when(rank.isin(0, 2) & (threat >= 0.45), "flag")
        .when(action == "deny", "deny")
        .when((action == "allow") & (rank == 0), "allow")
        .otherwise("flag")
    )


def training_signal(rank: Column, action: Column) -> Column:
    return ((rank == 0) & (action != "allow")) | (rank.isin(2, 3) & (action == "allow"))


# ---- tool responses


def schema_valid(response: Column, content_type: Column, required: list[str]) -> Column:
    """JSON must be an object with the required keys; other types are valid only without required keys."""
    keys = F.json_object_keys(response)
    is_object = F.ltrim(response).startswith("{") & keys.isNotNull()
    json_ok = is_object & (F.size(F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), F.coalesce(keys, F.array().cast("array<string>")))) == 0)
    return F.when(content_type == "json", F.coalesce(json_ok, F.lit(False))).otherwise(F.lit(not required))


def gate_verdict(own: Column, own_rank: Column, taint: Column, score: Column, valid: Column, threshold: float | Column = 0.65, mode: str = "monitor", resource_policy: str = "scan") -> Column:
    """Verdict of a response: earlier severity raises an allow only; score and schema come after and replace what stood."""
    effective = F.greatest(own_rank, taint)
    hard = "deny" if mode != "monitor" else "flag"
    base = F.when(own != "allow", own).when(effective >= 4, "deny").when(effective == 3, hard).when(effective == 2, "flag").otherwise("allow")
    late = "flag" if resource_policy == "scan" else "deny"
    base = F.when(score >= threshold, late).otherwise(base)
    return F.when(~valid, late).otherwise(base)


def bounded_bump(verdict: Column, rank: Column, trust: Column) -> Column:
    return F.when((verdict == "allow") & (trust <= 1) & rank.isin(1, 2), "flag").otherwise(verdict)


def running_taint(df: DataFrame, session: str, order: str, rank: str, policy: str = "accumulate") -> DataFrame:
    """``df`` with prior_taint (before the row) and taint (after it), in session order."""
    if policy == "reset":
        return df.selectExpr("*", f"coalesce(lag({rank}) over (partition by {session} order by {order}), 0) as prior_taint", f"{rank} as taint")
    w = f"over (partition by {session} order by {order} rows between unbounded preceding and"
    return df.selectExpr("*", f"coalesce(max({rank}) {w} 1 preceding), 0) as prior_taint", f"max({rank}) {w} current row) as taint")


def server_history(df: DataFrame, server: str, order: str, verdict: str) -> DataFrame:
    w = f"over (partition by {server} order by {order} rows between unbounded preceding and current row)"
    return df.selectExpr("*", f"count(*) {w} as seen", *[f"count_if({verdict} = '{v}') {w} as {n}" for v, n in (("allow", "allowed"), ("flag", "flagged"), ("deny", "denied"))])


def within_budget(tokens: Column, profile_budget: Column, config_budget: int) -> Column:
    return F.slice(tokens, 1, F.least(profile_budget, F.lit(config_budget)).cast("int"))


# ---- modalities


def modality_rank(text: Column, modality: str) -> Column:
    low = ascii_lower(text)
    return F.greatest(F.lit(0), F.lit(0), *[F.when(F.contains(low, F.lit(n)), r).otherwise(0) for n, r in MODALITY[modality].items()])


def modality_findings(text: Column, modality: str, text_rank: Column) -> Column:
    """(detail, rank) of each phrase of a modality, at least as severe as the text itself, and one more where the text speaks of both text and image."""
    low = ascii_lower(text)
    hits = [F.when(F.contains(low, F.lit(n)), F.struct(F.lit(f"detected {n}").alias("detail"), F.greatest(F.lit(r), text_rank).alias("rank"))) for n, r in MODALITY[modality].items()]
    found = F.array_compact(F.array(*hits))
    if modality == "audio":
        high = lambda k: F.struct(F.concat(F.lit("non-empty "), k).alias("detail"), F.lit(3).alias("rank"))
        found = F.concat(found, F.transform(audio_findings(text), high))
    crossing = F.array(F.struct(F.lit("cross-modal payload appears coherent across modalities").alias("detail"), F.lit(2).alias("rank")))
    return F.when((F.size(found) > 0) & F.contains(low, F.lit("text")) & F.contains(low, F.lit("image")), F.concat(found, crossing)).otherwise(found)


def instruction_signal(verdict: Column, reasons: Column, max_rank: Column) -> Column:
    """Whether a scanned text reads as an instruction: flagged for one of three reasons, or denied for something severe."""
    told = F.arrays_overlap(reasons, F.array(F.lit("InjectionPattern"), F.lit("Smuggling"), F.lit("CrossModalSmuggling")))
    return F.when(verdict == "flag", told).otherwise((verdict == "deny") & (max_rank >= 3))


def correlations(inputs: DataFrame, bundle: str) -> DataFrame:
    """Per bundle: correlations with the text channel, one for each video or document and one more where it is of medium severity at least. ``inputs`` has modality and rank."""
    carries = F.col("modality").isin("video", "document")
    return inputs.groupBy(bundle).agg((F.count_if(carries) + F.count_if(carries & (F.col("rank") >= 2))).alias("correlations"))


def channel_inputs(channels: DataFrame) -> DataFrame:
    """Perceived channels (source_id, kind, modality, content) as inputs of an audit: derived, untrusted, with their lineage."""
    return channels.select("modality", "content", F.lit("mcp_tool").alias("provenance"), F.concat_ws(":", "source_id", "kind").alias("source_id"), F.col("source_id").alias("derived_from"))


def modality_verdict(rank: Column, any_finding: Column) -> Column:
    return F.when(rank >= 4, "deny").when((rank >= 3) | any_finding, "flag").otherwise("allow")


def audio_findings(spectral_json: Column) -> Column:
    """Names of the non-empty finding lists in a spectral report."""
    has = lambda k: F.coalesce(F.json_array_length(F.get_json_object(spectral_json, f"$.{k}")) > 0, F.lit(False))
    return F.array_compact(F.array(*[F.when(has(k), k) for k in ("subliminal_findings", "steganography_findings")]))


def fusion(inputs: DataFrame, bundle: str) -> DataFrame:
    """Per bundle the severity ranks of the fusion rules (0: did not fire).

    ``inputs`` has provenance, instruction (boolean) and derived (boolean) for
    each channel. cross_trust: channels of unlike trust; cross_role: system
    beside anything but system and generated; instruction: an untrusted
    instruction beside higher trust; derived_authority: derived channels that
    claim system or user.
    """
    trust = default_trust(F.col("provenance"))
    g = inputs.groupBy(bundle).agg(
        F.count("*").alias("n"),
        F.min(trust).alias("low"),
        F.max(trust).alias("high"),
        F.bool_or(F.col("provenance") == "system").alias("system"),
        F.bool_or(~F.col("provenance").isin("system", "generated")).alias("other"),
        F.bool_or(F.col("instruction") & (trust == 0)).alias("untrusted_instruction"),
        F.count_if(F.col("derived") & F.col("provenance").isin("system", "user")).alias("derived"),
    )
    gap = F.col("high") - F.col("low")
    return g.select(
        bundle,
        F.when((F.col("n") >= 2) & (gap >= 2), 2).when((F.col("n") >= 2) & (gap > 0), 1).otherwise(0).alias("cross_trust"),
        F.when(F.col("system") & F.col("other"), 2).otherwise(0).alias("cross_role"),
        F.when(F.col("untrusted_instruction") & (F.col("high") > 0), 4).otherwise(0).alias("instruction"),
        F.when(F.col("derived") > 0, 3).otherwise(0).alias("derived_authority"),
        F.col("derived").alias("derived_events"),
    )


def cross_modal_verdict(rank: Column, correlations: Column) -> Column:
    return F.when(rank >= 4, "deny").when((rank >= 3) | (correlations > 1), "flag").otherwise("allow")


def fold_verdicts(modal: list[Column], text_rank: Column, taint: Column, cross: Column) -> Column:
    """One verdict from those of the modalities, the text and the crossing of both."""
    each = [F.when(v == "deny", 4).when(v == "flag", 2).otherwise(taint) for v in modal]
    top = F.greatest(text_rank, *each) if each else text_rank
    return F.when((cross == "deny") | (top >= 4), "deny").when(top >= 2, "flag").otherwise(cross)


def authority_ceiling(verdict: Column, fusion_events: Column) -> Column:
    return F.when(verdict == "deny", "escalate").when(verdict == "flag", "observe").when(fusion_events > 0, "draft").otherwise("act")
