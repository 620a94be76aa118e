"""Tool responses from a server to a session: profiles, budgets, hashes, verdicts and evidence records."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..policy import Policy
from . import decision as dec
from . import emit

#: What holds for a server without a profile.
DEFAULTS = {"trust": 0, "threshold": 0.65, "budget": 4096}


def profiles(responses: DataFrame, known: DataFrame, server: str = "server_id") -> DataFrame:
    """``responses`` with trust, threshold and budget of their servers; ``known`` has one row a server and is small beside the responses."""
    rows = known.select(F.col(server), *[F.col(c).alias(f"_{c}") for c in DEFAULTS])
    return responses.join(rows, server, "left").withColumns({c: F.coalesce(F.col(f"_{c}"), F.lit(v)) for c, v in DEFAULTS.items()}).drop(*[f"_{c}" for c in DEFAULTS])


def _fnv(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts.to_pylist():
        h = 0xCBF29CE484222325
        for b in (t or "").encode():
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        out.append(f"{h:016x}")
    return pa.array(out, type=pa.string())


_fnv.__annotations__ = {"texts": pa.Array, "return": pa.Array}


def response_hash(text: Column, prefix: str = "mcp-") -> Column:
    """64-bit FNV-1a of the bytes, in hex; it names a response and protects nothing."""
    return F.concat(F.lit(prefix), F.arrow_udf(_fnv, "string")(text))


def inspect(responses: DataFrame, known: DataFrame, session: str, order: str, policy: Policy | None = None, text: str = "response", valid: Column | None = None, tokens: Column | None = None, most_tokens: int = 4096, resource_policy: str = "scan") -> DataFrame:
    """Scan, gate and record each response of a session, in order.

    ``responses`` has server_id, request_hash and the text. Severities of earlier
    responses of the session raise an allow; the score and the schema come after
    and replace what stood; servers of little trust get a flag for low findings.
    """
    policy = policy or Policy()
    rows = emit.scan(profiles(responses, known), policy, text).withColumn("_rank", F.col("max_rank"))
    rows = dec.running_taint(rows, session, order, "_rank", policy.taint)
    valid = F.lit(True) if valid is None else valid
    used = F.least(F.lit(0) if tokens is None else tokens, F.col("budget"), F.lit(most_tokens))
    verdict = dec.gate_verdict(F.col("verdict"), F.col("max_rank"), F.col("prior_taint"), F.col("injection_score"), valid, F.col("threshold"), policy.mode, resource_policy)
    verdict = dec.bounded_bump(verdict, F.col("max_rank"), F.col("trust"))
    return rows.withColumns({"schema_valid": valid, "tokens_consumed": used.cast("long"), "final_verdict": verdict, "response_hash": response_hash(F.col(text))}).drop("_rank")


def evidence_records(inspected: DataFrame, version: str, as_of_ms: int) -> DataFrame:
    """One record a response; the time is given, so that a run can be repeated."""
    return inspected.select(
        "server_id", "request_hash", "response_hash", F.struct("verdict", "max_rank", "threat_count", "injection_score", "findings").alias("scan_result"), F.lit("mcp_tool").alias("taint_applied"),
        "tokens_consumed", "schema_valid", "final_verdict", F.lit(as_of_ms).cast("long").alias("timestamp_unix_ms"), F.lit(version).alias("version"),
    )
