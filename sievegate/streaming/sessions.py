"""Session state on streams: taint and history of a tool gate, slow-rate repetition, probe windows, and the evidence sink.

State is kept by key and holds numbers, or what lies within a window, never the
rows seen. Inside a micro-batch the rows of a key are taken in their order
column; across batches, as they come. Run over the same rows in order, each
gives what the batch operator gives.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.probe import REFUSALS, words_in


def running_taint(rows: DataFrame, session: str, order: str, rank: str, policy: str = "accumulate") -> DataFrame:
    """``rows`` with prior_taint and taint; with the policy ``reset`` only the response before counts."""
    out = T.StructType([*rows.schema.fields, T.StructField("prior_taint", T.IntegerType()), T.StructField("taint", T.IntegerType())])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taint = state.get[0] if state.exists else 0
        part = pd.concat(list(batches)).sort_values(order, kind="stable").reset_index(drop=True)
        prior, after = [], []
        for r in part[rank].fillna(0).astype(int):
            prior.append(taint)
            taint = r if policy == "reset" else max(taint, r)
            after.append(taint)
        state.update((taint,))
        yield part.assign(prior_taint=pd.array(prior, dtype="int32"), taint=pd.array(after, dtype="int32"))

    return rows.groupBy(session).applyInPandasWithState(step, out, "taint int", "append", GroupStateTimeout.NoTimeout)


def server_history(rows: DataFrame, server: str, order: str, verdict: str) -> DataFrame:
    """``rows`` with the numbers of responses seen, allowed, flagged and denied so far, by server."""
    names = ["seen", "allowed", "flagged", "denied"]
    out = T.StructType([*rows.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get if state.exists else (0, 0, 0, 0)
        part = pd.concat(list(batches)).sort_values(order, kind="stable").reset_index(drop=True)
        hits = [pd.Series(1, index=part.index), *[(part[verdict] == v).astype(int) for v in ("allow", "flag", "deny")]]
        sums = [h.cumsum() + b for h, b in zip(hits, before, strict=True)]
        state.update(tuple(int(s.iloc[-1]) for s in sums))
        yield part.assign(**{n: s.astype("int64") for n, s in zip(names, sums, strict=True)})

    return rows.groupBy(server).applyInPandasWithState(step, out, "seen long, allowed long, flagged long, denied long", "append", GroupStateTimeout.NoTimeout)


def slow_rate(rows: DataFrame, key: str, at: str, text: str, window_s: int = 3600, most: int = 10, n: int = 4, least: float = 0.3) -> DataFrame:
    """After each micro-batch, for each key in it: inputs in the window before its latest one, whether they are too many, similar pairs among them, and the severity.

    ``at`` is a timestamp. State holds the n-gram hashes of the inputs within the
    window; it goes when the watermark passes their end. Inputs that come later
    than the watermark are dropped.
    """
    rows = rows.withWatermark(at, f"{window_s} seconds")
    kind = rows.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("inputs_in_window", T.LongType()), T.StructField("rate_exceeded", T.BooleanType()), T.StructField("pairs", T.LongType()), T.StructField("severity", T.StringType())])

    def grams(t: str | None) -> list[str]:
        t = t or ""
        return sorted({t[i : i + n] for i in range(len(t) - n + 1)})

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else []
        for part in batches:
            held += [[x.timestamp(), grams(t)] for x, t in zip(part[at], part[text], strict=True)]
        held.sort(key=lambda h: h[0])
        now = held[-1][0]
        held = [h for h in held if h[0] >= now - window_s]
        state.update((json.dumps(held),))
        # a time of waiting must lie behind the watermark
        state.setTimeoutTimestamp(max(int((now + window_s) * 1000), state.getCurrentWatermarkMs() + 1))
        sets = [set(h[1]) for h in held]
        alike = lambda a, b: bool(a | b) and len(a & b) >= least * len(a | b)
        pairs = sum(alike(a, b) for i, a in enumerate(sets) for b in sets[i + 1 :]) if len(held) >= 3 else 0
        inside = len(held) if len(held) >= 3 else 0
        fast = inside > most
        severity = "high" if fast and pairs else "medium" if fast or pairs else "none"
        yield pd.DataFrame({key: [k[0]], "inputs_in_window": [inside], "rate_exceeded": [fast], "pairs": [pairs], "severity": [severity]})

    return rows.groupBy(key).applyInPandasWithState(step, out, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def probe_windows(samples: DataFrame, at: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Refusal rate, latency a word and number of samples (output, latency_ms) in tumbling windows."""
    low = F.lower("output")
    refused: Column = F.lit(False)
    for r in REFUSALS:
        refused = refused | F.contains(low, F.lit(r))
    rows = samples.withWatermark(at, late) if samples.isStreaming else samples
    ratio = F.col("latency_ms") / F.greatest(F.lit(1), words_in(F.col("output")))
    return rows.groupBy(F.window(at, width).alias("w")).agg(F.avg(refused.cast("int")).alias("refusal_rate"), F.avg(ratio).alias("latency_ratio"), F.count("*").alias("samples")).select(F.col("w.start").alias("start"), "refusal_rate", "latency_ratio", "samples")


def evidence_sink(records: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append records as JSON lines. A record that cannot be written fails the query; what a checkpoint has seen is written once."""
    rows = records.withColumn("persisted", F.lit(True))
    return rows.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
