"""Exact top-k by inner product with the three-phase uniform threshold.

The components of the vectors are dealt to ``lists`` groups; a candidate's score
is the sum of its group scores. Per query: (1) each task sends the k highest
entries of each of its lists and the list's lowest value; with unsent entries
taken at the lowest, the k-th highest sum of a row is a safe cutoff. (2) The cutoff is
broadcast; shifted by the lowest values it gives the uniform threshold, cutoff /
lists, and a list gives its entries from that on. A candidate counts only if it
has one and its entries with thresholds for the rest reach the cutoff. (3) The
missing entries of these candidates are looked up, list by list, as long as the
cutoff can still be reached; each task keeps at most its k best for each query.

Queries come in blocks of ``block`` vectors, so what is broadcast has a fixed
bound; each block is one pass over the candidates. All arithmetic is on
integers below 2**53 held in doubles, whose sums are exact.

Defined cases: null vectors and vectors with null or non-finite components take
no part; shorter vectors count as padded with zeros; rows with the query's own
id are no candidates of it; repeated candidate rows count each; equal query
rows are one query; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store
from .texts import tidied

LISTS = 4
BLOCK = 4096
_CELLS = 1 << 19


def _matrix(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    flat, off = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
    size = np.diff(off)
    wide = max(width, int(size.max())) if len(size) else width
    out = np.zeros((len(ids), wide))
    out[np.repeat(np.arange(len(ids)), size), np.arange(len(flat[off[0] : off[-1]])) - np.repeat(off[:-1] - off[0], size)] = flat[off[0] : off[-1]]
    yield ids, out[:, :width]


def _keep(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each column, by score and then smaller id."""
    order = np.lexsort((ids, -score), axis=0)[:k]
    return np.take_along_axis(score, order, axis=0), np.take_along_axis(ids, order, axis=0)


def _first(queries: np.ndarray, own: np.ndarray, groups: list[np.ndarray], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, width = queries.shape
        best = [(np.full((0, q), 0.0), np.full((0, q), 0)) for _ in groups]
        low = np.full((len(groups), q), np.inf)
        for batch in batches:
            number = batch.column(2).to_numpy()
            for ids, m in _matrix(batch, width):
                step = max(k, _CELLS // max(1, q))
                for i in range(0, len(ids), step):
                    part, pid, row = m[i : i + step], ids[i : i + step], number[i : i + step]
                    self_ = pid[:, None] == own[None, :]
                    for g, cols in enumerate(groups):
                        s = part[:, cols] @ queries[:, cols].T
                        low[g] = np.minimum(low[g], s.min(axis=0))
                        s[self_] = -np.inf
                        if len(s) > k:
                            top = np.argpartition(-s, k - 1, axis=0)[:k]
                            s, who = np.take_along_axis(s, top, axis=0), row[top]
                        else:
                            who = np.broadcast_to(row[:, None], s.shape)
                        best[g] = _keep(np.concatenate((best[g][0], s)), np.concatenate((best[g][1], who)), k)
        for g, (s, who) in enumerate(best):
            ok = np.isfinite(s)
            at = np.broadcast_to(np.arange(q), s.shape)[ok]
            yield _rows(at, np.full(len(at), g), who[ok], s[ok], False)
            seen = np.isfinite(low[g])
            yield _rows(np.flatnonzero(seen), np.full(seen.sum(), g), np.zeros(seen.sum()), low[g][seen], True)

    return tidied(run)


def _rows(query, part, who, score, low) -> pa.RecordBatch:
    kinds = (np.int32, np.int32, np.int64, np.int64)
    columns = [pa.array(np.asarray(x).astype(t)) for x, t in zip((query, part, who, score), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(query), low))], names=["query", "part", "row", "score", "low"])


def sufficient(part: np.ndarray, queries: np.ndarray, groups: list[np.ndarray], low: np.ndarray, shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phase 2: the entries of each list from the uniform threshold on, as pairs (row, query) with the sum of their entries and which lists gave one.

    A pair without an entry stays below the cutoff, and so does one whose
    entries with thresholds for the rest do; neither is sent.
    """
    uniform = np.floor(shifted / len(groups))
    sent, known, missing = None, 0.0, 0
    for g, cols in enumerate(groups):
        s = part[:, cols] @ queries[:, cols].T - low[g]
        hit = s >= uniform
        sent = hit[None] if sent is None else np.concatenate((sent, hit[None]))
        known = known + np.where(hit, s, 0.0)
        missing = missing + ~hit
    x, y = np.nonzero(sent.any(axis=0) & (known + missing * uniform >= shifted))
    return x, y, known[x, y], sent[:, x, y]


def resolved(part: np.ndarray, queries: np.ndarray, groups: list[np.ndarray], low: np.ndarray, shifted: np.ndarray, x: np.ndarray, y: np.ndarray, known: np.ndarray, sent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Phase 3: pairs at the cutoff or above with their scores, and how many entries were looked up.

    The missing entries of the pairs are looked up list by list; a pair leaves
    as soon as thresholds for what is still missing do not reach the cutoff.
    """
    uniform, looked = np.floor(shifted / len(groups)), 0
    missing = (~sent).sum(axis=0)
    for g, cols in enumerate(groups):
        need = np.flatnonzero(~sent[g])
        for i in range(0, len(need), 1 << 14):
            some = need[i : i + (1 << 14)]
            known[some] += np.einsum("ij,ij->i", part[np.ix_(x[some], cols)], queries[np.ix_(y[some], cols)]) - low[g, y[some]]
        missing[need] -= 1
        looked += len(need)
        stay = known + missing * uniform[y] >= shifted[y]
        x, y, known, missing, sent = x[stay], y[stay], known[stay], missing[stay], sent[:, stay]
    return x, y, known + low.sum(axis=0)[y], looked


def _second(queries: np.ndarray, own: np.ndarray, groups: list[np.ndarray], k: int, cutoff: np.ndarray, low: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, width = queries.shape
        shifted = cutoff - low.sum(axis=0)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for ids, m in _matrix(batch, width):
                step = max(1, _CELLS // max(1, q))
                for i in range(0, len(ids), step):
                    part, pid = m[i : i + step], ids[i : i + step]
                    x, y, known, sent = sufficient(part, queries, groups, low, shifted)
                    other = pid[x] != own[y]
                    x, y, exact, _ = resolved(part, queries, groups, low, shifted, x[other], y[other], known[other], sent[:, other])
                    if not len(y):
                        continue
                    order = np.argsort(y, kind="stable")
                    x, y, exact = x[order], y[order], exact[order]
                    cuts = np.flatnonzero(np.concatenate(([True], y[1:] != y[:-1])))
                    for a, b in zip(cuts, [*cuts[1:], len(y)], strict=True):
                        s, who = exact[a:b], pid[x[a:b]]
                        if y[a] in best:
                            s, who = np.concatenate((best[y[a]][0], s)), np.concatenate((best[y[a]][1], who))
                        top = np.lexsort((who, -s))[:k]
                        best[y[a]] = s[top], who[top]
        for at, (s, who) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), own[at], dtype=np.int64)), pa.array(who.astype(np.int64)), pa.array(s.astype(np.int64))], names=["query_id", "vec_id", "score"])

    return tidied(run)


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024, lists: int = LISTS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products of each query; components are floor(scale * x)."""
    if k < 1 or lists < 1 or block < 1:
        raise ValueError("k, lists and block must be positive")
    spark = vectors.sparkSession
    store = Store(spark, "topk")

    def whole(df: DataFrame) -> DataFrame:
        x = F.col(vector)
        bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
        parts = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double"))
        return df.where(F.col(key).isNotNull() & x.isNotNull() & ~F.coalesce(F.exists(x, bad), F.lit(False))).select(F.col(key).cast("long").alias("id"), parts.alias("x"))

    rows, asked = whole(vectors), whole(queries)
    numbered = rows.withColumn("row", F.monotonically_increasing_id())  # repeated rows are kept apart
    out, number = None, 0

    def search(some: list) -> None:
        nonlocal out, number
        width = max(1, *(len(r[1]) for r in some))
        own = np.array([r[0] for r in some], dtype=np.int64)
        q = np.zeros((len(some), width))
        for i, r in enumerate(some):
            q[i, : len(r[1])] = r[1]
        groups = [c for c in np.array_split(np.arange(width), lists) if len(c)]
        sent = store.put(f"sent{number}", numbered.mapInArrow(_first(q, own, groups, k), "query int, part int, row long, score long, low boolean"))
        low = np.zeros((len(groups), len(some)))
        for r in sent.where("low").groupBy("query", "part").agg(F.min("score").alias("s")).collect():
            low[r["part"], r["query"]] = r["s"]
        floor_ = sent.where("low").groupBy("query", "part").agg(F.min("score").alias("s"))
        over = sent.where("not low").join(floor_, ["query", "part"]).groupBy("query", "row").agg(F.sum(F.col("score") - F.col("s")).alias("s"))
        ranked = over.selectExpr("query", "s", "row_number() over (partition by query order by s desc) as r").where(F.col("r") == k)
        cutoff = np.full(len(some), -np.inf)
        for r in ranked.collect():
            cutoff[r["query"]] = r["s"] + low[:, r["query"]].sum()
        found = rows.mapInArrow(_second(q, own, groups, k, np.maximum(cutoff, low.sum(axis=0)), low), "query_id long, vec_id long, score long")
        found.write.mode("append").parquet(f"{store.path}/found")
        store.drop(f"sent{number}")
        number += 1

    waiting: list = []
    for r in asked.dropDuplicates(["id", "x"]).toLocalIterator():
        waiting.append((r[0], r[1]))
        if len(waiting) == block:
            search(waiting)
            waiting = []
    if waiting:
        search(waiting)
    if not number:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(f"{store.path}/found")
    return found.selectExpr("query_id", "row_number() over (partition by query_id order by score desc, vec_id) as rank", "vec_id", "score").where(F.col("rank") <= k)


#: DuckDB: the contract of the query, by comparing all.
ORACLE = """
with whole as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from whole q join whole c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 10
"""
