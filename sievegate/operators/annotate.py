"""Findings laid over clusters and tokens: as arrays within a row, or as long tables by an overlap join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import overlap_join


def threat_of(start: Column, end: Column, findings: Column) -> Column:
    """What findings say of one span: highest severity, distinct detectors and first evidence in the order of the findings, highest confidence."""
    here = F.filter(findings, lambda f: (f.start < end) & (start < f.end))
    top = lambda x, none: F.coalesce(F.array_max(x), F.lit(none))
    said = F.filter(F.transform(here, lambda f: f.evidence), lambda e: e != "")
    return F.struct(
        top(F.transform(here, lambda f: f["rank"]), 0).alias("rank"),
        F.array_distinct(F.transform(here, lambda f: f.detector)).alias("detectors"),
        top(F.transform(here, lambda f: f.confidence), 0.0).alias("confidence"),
        F.coalesce(F.get(said, F.lit(0)), F.lit("")).alias("evidence"),
    )


def annotate(spans: Column, findings: Column) -> Column:
    """Each span of an array (with start and end) beside its threat; for clusters and tokens alike."""
    return F.transform(spans, lambda s: F.struct(s.alias("span"), threat_of(s.start, s.end, findings).alias("threat")))


def annotate_spans(spans: DataFrame, findings: DataFrame, key: str, page: int = 1024) -> DataFrame:
    """The same for long tables. ``spans`` has key, start, end and more; ``findings`` has key, ord, start, end, rank, detector, confidence, evidence.

    The join is dealt by key and page of ``page`` bytes; spans without findings
    have rank 0, no detector and empty evidence.
    """
    both = overlap_join(spans.select(key, "start", "end"), findings, key, page)
    by_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(F.col("r_ord"), F.col(c).alias("x")))), lambda s: s.x)
    folded = both.groupBy(key, "l_start", "l_end").agg(
        F.max("r_rank").alias("rank"), F.array_distinct(by_order("r_detector")).alias("detectors"), F.max("r_confidence").alias("confidence"),
        F.min_by("r_evidence", F.when(F.col("r_evidence") != "", F.col("r_ord"))).alias("evidence"),
    )
    folded = folded.withColumnsRenamed({"l_start": "start", "l_end": "end"})
    none = {"rank": F.lit(0), "detectors": F.array().cast("array<string>"), "confidence": F.lit(0.0), "evidence": F.lit("")}
    return spans.join(folded, [key, "start", "end"], "left").withColumns({c: F.coalesce(F.col(c), v) for c, v in none.items()})
