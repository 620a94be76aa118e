"""Model health: signals over (input, output, latency_ms) samples, drift and action. All grouped aggregates and joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import band
from .decision import ascii_lower, clip

#: What a refusal says.
REFUSALS = ["i can't", "cannot comply", "i cannot", "refuse", "not able"]


def _byte_entropy(texts: pa.Array) -> pa.Array:
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    out = np.zeros(len(texts))
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        if b > a:
            p = np.bincount(raw[a:b])
            p = p[p > 0] / (b - a)
            out[i] = -(p * np.log2(p)).sum()
    return pa.array(out)


_byte_entropy.__annotations__ = {"texts": pa.Array, "return": pa.Array}


def entropy(text: Column) -> Column:
    """Shannon bits over the bytes of a text, by a histogram of each text in Arrow batches; 0 for an empty or null one."""
    return F.arrow_udf(_byte_entropy, "double")(F.coalesce(text, F.lit("")))


def words_in(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\\s+"), lambda w: w != ""))


def correlation(df: DataFrame) -> DataFrame:
    gap = clip(F.abs(entropy(F.col("input")) - entropy(F.col("output"))) / 8)
    slow = clip(F.col("latency_ms") / F.greatest(F.lit(1), words_in(F.col("output"))) / 250)
    return df.agg(F.round(F.coalesce(F.avg(0.5 * gap + 0.5 * slow), F.lit(1.0)), 6).alias("correlation"))


def token_shares(df: DataFrame, text: str = "output") -> DataFrame:
    words = df.select(F.explode(F.split(ascii_lower(F.col(text)), "\\s+")).alias("token")).where("token <> ''")
    counts = words.groupBy("token").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("token", (F.col("n") / F.col("total")).alias("share"))


def distribution_shift(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Half the summed differences of word shares over the current words; 0 if a side has none."""
    p, q = token_shares(current), token_shares(baseline).withColumnRenamed("share", "base")
    any_ = baseline.agg(F.coalesce(F.bool_or(F.trim("output") != ""), F.lit(False)).alias("known"))
    shift = p.join(q, "token", "left").agg((F.coalesce(F.sum(F.abs(F.col("share") - F.coalesce("base", F.lit(0.0)))) / 2, F.lit(0.0))).alias("shift"))
    return shift.crossJoin(any_).select(F.round(F.when(F.col("known"), F.col("shift")).otherwise(0.0), 6).alias("shift"))


def refusal_rate(df: DataFrame) -> DataFrame:
    low = ascii_lower(F.col("output"))
    hit = F.lit(False)
    for r in REFUSALS:
        hit = hit | F.contains(low, F.lit(r))
    return df.agg(F.round(F.coalesce(F.avg(hit.cast("int")), F.lit(0.0)), 6).alias("refusal_rate"))


def latency_ratio(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.avg(F.col("latency_ms") / F.greatest(F.lit(1), words_in(F.col("output")))), F.lit(0.0)).alias("ratio"))


def latency_skew(current: DataFrame, baseline: DataFrame) -> DataFrame:
    both = latency_ratio(current).crossJoin(latency_ratio(baseline).withColumnRenamed("ratio", "base"))
    skew = F.when(F.col("base") <= 0, 0.0).otherwise(clip(F.abs(F.col("ratio") - F.col("base")) / F.greatest(F.col("base"), F.lit(1.0))))
    return both.select(F.round(skew, 6).alias("latency_skew"))


def unmet(cases: DataFrame, samples: DataFrame, fragment: str) -> DataFrame:
    """Cases (canaries, fingerprints) with no sample of the same input whose output has the fragment."""
    s = samples.select(F.col("input").alias("i"), F.col("output").alias("o"))
    return cases.join(s, (cases["input"] == s["i"]) & F.contains(s["o"], cases[fragment]), "left_anti")


def violated(cases: DataFrame, samples: DataFrame, fragment: str = "forbidden_fragment") -> DataFrame:
    s = samples.select(F.col("input").alias("i"), F.col("output").alias("o"))
    return cases.join(s, (cases["input"] == s["i"]) & F.contains(s["o"], cases[fragment]), "left_semi")


def consistency_variants(samples: DataFrame) -> DataFrame:
    return samples.groupBy("input").agg(F.count_distinct("output").alias("n")).where("n > 1").agg(F.count("*").alias("variants"))


def aggregate_drift(scores: Column) -> Column:
    """0.7 of the highest and 0.3 of the mean score."""
    n = F.greatest(F.size(scores), F.lit(1))
    return clip(0.7 * F.coalesce(F.array_max(scores), F.lit(0.0)) + 0.3 * F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / n)


def health_score(drift: Column, scores: Column, identity: Column) -> Column:
    return clip(1 - drift - 0.1 * F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) + 0.1 * identity)


def severity_band(score: Column) -> Column:
    return band(score, [0.15, 0.40, 0.70, 0.90], ["none", "low", "medium", "high", "critical"])


def drift_band(score: Column) -> Column:
    return band(score, [0.25, 0.50, 0.75, 0.90], ["none", "low", "medium", "high", "critical"])


def action(triggered: Column, score: Column, identity: Column, drift: Column, baseline_age_s: Column) -> Column:
    return (
        F.when(triggered, "shield_audit")
        .when(score < 0.45, "failover")
        .when(identity < 0.5, "identity_verification")
        .when(drift >= 0.6, "alert")
        .when((drift >= 0.3) | (baseline_age_s > 86_400), "increased_monitoring")
        .otherwise("nominal")
    )


def baseline_profile(samples: DataFrame) -> DataFrame:
    """One row: mean entropies, mean latency a word and refusal rate of (input, output, latency_ms) samples; zeros without samples. The word shares are ``token_shares``."""
    low = ascii_lower(F.col("output"))
    refused = F.lit(False)
    for r in REFUSALS:
        refused = refused | F.contains(low, F.lit(r))
    mean = lambda x: F.round(F.coalesce(F.avg(x), F.lit(0.0)), 6)
    return samples.agg(
        mean(entropy(F.col("input"))).alias("input_entropy"), mean(entropy(F.col("output"))).alias("output_entropy"),
        mean(F.col("latency_ms") / F.greatest(F.lit(1), words_in(F.col("output")))).alias("latency_ratio"), mean(refused.cast("int")).alias("refusal_rate"), F.count("*").alias("samples"),
    )


def signals(samples: DataFrame, baseline: DataFrame, canaries: DataFrame, fingerprints: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(kind, score, severity): five signals always, and canary, boundary and consistency signals where there is something to tell.

    All joins are between single rows of aggregates. ``canaries``, ``fingerprints``
    and ``boundaries`` have input and fragment.
    """
    one = correlation(samples).crossJoin(distribution_shift(samples, baseline)).crossJoin(refusal_rate(samples)).crossJoin(refusal_rate(baseline).withColumnRenamed("refusal_rate", "base_refusal")).crossJoin(latency_skew(samples, baseline))
    size = lambda df, name: df.agg(F.count("*").alias(name))
    one = one.crossJoin(size(unmet(canaries, samples, "fragment"), "failed")).crossJoin(size(canaries, "canaries")).crossJoin(size(unmet(fingerprints, samples, "fragment"), "unlike")).crossJoin(size(fingerprints, "fingerprints"))
    one = one.crossJoin(size(violated(boundaries, samples, "fragment"), "crossed")).crossJoin(size(boundaries, "boundaries")).crossJoin(consistency_variants(samples)).crossJoin(size(samples, "n"))
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    each = {
        "input_output_correlation": F.col("correlation"), "output_distribution_shift": F.col("shift"), "refusal_rate": F.abs(F.col("refusal_rate") - F.col("base_refusal")), "latency_skew": F.col("latency_skew"),
        "capability_regression": F.when(F.col("failed") > 0, share("failed", "canaries")), "model_identity": clip(share("unlike", "fingerprints")),
        "boundary_drift": F.when(F.col("crossed") > 0, share("crossed", "boundaries")), "consistency_drift": F.when(F.col("variants") > 0, F.least(F.lit(1.0), share("variants", "n"))),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.round(v.cast("double"), 6).alias("score")) for k, v in each.items()])
    return one.select(F.explode(rows).alias("s")).select("s.kind", "s.score", severity_band(F.col("s.score")).alias("severity")).where("score is not null")
