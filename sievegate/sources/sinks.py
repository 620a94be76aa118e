"""Evidence as JSON lines, results for people and machines, bench reports and their telemetry."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_evidence(records: DataFrame, path: str) -> None:
    """Append one record a line. Fail-closed: a record that cannot be written fails the call, and only written ones say ``persisted``."""
    records.withColumn("persisted", F.lit(True)).write.mode("append").json(path)


def record_each(records: DataFrame, sink: Callable[[], Callable[[dict], None]]) -> None:
    """Hand every record to a sink of one's own, made once a partition. Fail-closed: what the sink raises fails the call; a retried task hands its records over again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, many = sink(), 0
        for batch in batches:
            for row in batch.to_pylist():
                record(row)
                many += 1
        yield pa.RecordBatch.from_arrays([pa.array([many], type=pa.int64())], names=["n"])

    records.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def results(df: DataFrame) -> DataFrame:
    """One JSON object a row: {"result": ...}."""
    return df.select(F.to_json(F.struct(F.struct(*df.columns).alias("result"))).alias("value"))


def bench_report(rows: list[dict], form: str = "json") -> str:
    """Bench results (preset, sequential_ns, parallel_ns, tokens, outputs_match) as json, jsonl, csv or lines for people."""
    if form == "json":
        return json.dumps({"result": rows})
    if form == "jsonl":
        return "\n".join(map(json.dumps, rows))
    if form == "csv":
        out = io.StringIO()
        writer = csv.DictWriter(out, fieldnames=list(rows[0]) if rows else [])
        writer.writeheader()
        writer.writerows(rows)
        return out.getvalue()
    return "\n".join(", ".join(f"{k}: {v}" for k, v in r.items()) for r in rows)


def telemetry(rows: list[dict], false_positive_rate: float, references: list[str]) -> dict:
    """Bench results folded to one bundle; rates outside 0..1 and outputs that differ are errors."""
    if not 0 <= false_positive_rate <= 1:
        raise ValueError("the false positive rate must lie in 0..1")
    if any(not r.get("outputs_match") for r in rows):
        raise ValueError("sequential and parallel outputs differ")
    return {"presets": sorted(r["preset"] for r in rows), "tokens": sum(r["tokens"] for r in rows), "slowest_ns": max((r["sequential_ns"] for r in rows), default=0), "false_positive_rate": false_positive_rate, "references": sorted(set(references))}
