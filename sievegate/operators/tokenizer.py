"""Byte-level BPE by rank files, special tokens, and merges that never cross a provenance boundary.

Pieces are cut and merged inside Arrow batches: by the compiled core of the
public ``tiktoken`` package where that is installed, else by the merge below
with a cache of distinct pieces per task. Both merge the adjacent pair of the
lowest rank first, the leftmost on ties.
"""

from __future__ import annotations

import base64
import functools
import heapq
import importlib.util
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import of_lists, parts, short_batches
from ..functions.severity import DEFAULT_TRUST, TRUST
from ..functions.textmap import TextMap, clusters

#: How text is cut before merging, by family.
PATTERNS = {
    "r50k": r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++\z|\s+(?!\S)|\s",
    "cl100k": r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++\z|\s*[\r\n]|\s+(?!\S)|\s",
    "o200k": r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+",
}
#: Encodings, their families and special tokens.
ENCODINGS = {
    "gpt2": ("r50k", {"<|endoftext|>": 50256}),
    "r50k_base": ("r50k", {"<|endoftext|>": 50256}),
    "p50k_base": ("r50k", {"<|endoftext|>": 50256}),
    "p50k_edit": ("r50k", {"<|endoftext|>": 50256, "<|fim_prefix|>": 50281, "<|fim_middle|>": 50282, "<|fim_suffix|>": 50283}),
    "cl100k_base": ("cl100k", {"<|endoftext|>": 100257, "<|fim_prefix|>": 100258, "<|fim_middle|>": 100259, "<|fim_suffix|>": 100260, "<|endofprompt|>": 100276}),
    "o200k_base": ("o200k", {"<|endoftext|>": 199999, "<|endofprompt|>": 200018}),
}
#: Named tokens of o200k_harmony; the other ids from 200000 to 201087 are reserved.
HARMONY = {"<|startoftext|>": 199998, "<|endoftext|>": 199999, "<|return|>": 200002, "<|constrain|>": 200003, "<|channel|>": 200005, "<|start|>": 200006, "<|end|>": 200007, "<|message|>": 200008, "<|call|>": 200012}
ENCODINGS["o200k_harmony"] = ("o200k", HARMONY | {f"<|reserved_{i}|>": i for i in range(200000, 201088) if i not in HARMONY.values()})


def pretokenize(text: Column, family: str = "r50k") -> Column:
    """Pieces of a text; the flag makes Java's classes those of Unicode."""
    return F.regexp_extract_all(text, F.lit("(?U)" + PATTERNS[family]), F.lit(0))


def load_ranks(text: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in text.splitlines() if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece, by a heap of adjacent pairs; a byte without a rank is an error."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
    heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or not alive[j] or end[j] != stop:
            continue  # one of the two has been merged meanwhile
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := before[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Vocabulary:
    def __init__(self, name: str, ranks: dict[bytes, int], compiled: bool = True) -> None:
        if name not in ENCODINGS:
            raise ValueError(f"unknown encoding {name}")
        self.family, self.special = ENCODINGS[name]
        self.ranks, self.cache = ranks, {}
        self.pattern = regex.compile(PATTERNS[self.family].replace(r"\z", r"\Z"))
        self.bytes_of = {i: b for b, i in ranks.items()} | {i: t.encode() for t, i in self.special.items()}
        self._columns: tuple[np.ndarray, pa.Array, pa.Array] | None = None
        self.core = None
        if compiled and importlib.util.find_spec("tiktoken") is not None and all(bytes([b]) in ranks for b in range(256)):
            import tiktoken

            self.core = tiktoken.Encoding(name, pat_str=PATTERNS[self.family], mergeable_ranks=ranks, special_tokens={})

    def ordinary(self, text: str) -> list[int]:
        if self.core:
            return self.core.encode_ordinary(text)
        out: list[int] = []
        for p in self.pattern.findall(text):
            if p not in self.cache:
                if len(self.cache) > 500_000:
                    self.cache.clear()
                self.cache[p] = merge_piece(p.encode(), self.ranks)
            out += self.cache[p]
        return out

    def encode(self, text: str, allowed: str | Iterable[str] = "none") -> list[int]:
        """``none``: a special token in the text is an error; ``all`` or some names: these are encoded as themselves, others are errors. The leftmost one goes first, the longest on ties."""
        names = set(self.special) if allowed == "all" else set() if allowed == "none" else set(allowed) & set(self.special)
        if "<|" not in text:
            return self.ordinary(text)
        for t in self.special:
            if t not in names and t in text:
                raise ValueError(f"special token {t} is not allowed")
        if not names:
            return self.ordinary(text)
        out, at = [], 0
        for m in re.finditer("|".join(re.escape(t) for t in sorted(names, key=len, reverse=True)), text):
            out += [*self.ordinary(text[at : m.start()]), self.special[m.group()]]
            at = m.end()
        return out + self.ordinary(text[at:])

    def single(self, token: bytes) -> int:
        """The id of exactly these bytes, special tokens first."""
        found = self.special.get(token.decode("utf-8", "replace"), self.ranks.get(token))
        if found is None:
            raise KeyError(f"no token for {token!r}")
        return found

    def columns(self) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Size (-1 where there is no token), bytes and text of each id."""
        if self._columns is None:
            raw: list[bytes | None] = [None] * (max(self.bytes_of, default=-1) + 1)
            for i, b in self.bytes_of.items():
                raw[i] = b
            text = pa.array([None if b is None else b.decode("utf-8", "replace") for b in raw], type=pa.string())
            self._columns = np.array([-1 if b is None else len(b) for b in raw], dtype=np.int64), pa.array(raw, type=pa.binary()), text
        return self._columns

    def spans(self, ids: list[int], base: int = 0) -> list[tuple[int, int, int, str]]:
        """(id, start, end, text) of tokens that follow each other, in bytes."""
        raw = [self.bytes_of[i] for i in ids]
        ends = list(accumulate(map(len, raw), initial=base))
        return [(i, a, b, r.decode("utf-8", "replace")) for i, a, b, r in zip(ids, ends, ends[1:], raw, strict=False)]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(self.bytes_of[i] for i in ids)

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def _vocabulary(encoding: str, spec: str) -> Vocabulary:
    """Kept by a Python worker from one task to the next."""
    return Vocabulary(encoding, load_ranks(spec))


#: Results of some rows as an array, from their values; what fails is None there and an error in the list beside it.
Made = tuple[pa.Array, list[str | None]]


def _in_parts(df: DataFrame, ranks_path: str, encoding: str, key: str, column: Column, make: Callable[[Vocabulary, pa.Array], Made], name: str, sql: str) -> DataFrame:
    """key, a result and an error (null where none) for each row, about a MB of input at a time."""
    short_batches(df.sparkSession)
    with open(ranks_path) as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocabulary(encoding, spec.value)
        for batch in batches:
            for part in parts(batch):
                found, errors = make(vocab, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), found, pa.array(errors, type=pa.string())], names=[key, name, "error"])

    return df.select(key, column.alias("_t")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {name} {sql}, error string")


def _tried(values: pa.Array, one: Callable) -> tuple[list, list[str | None]]:
    """The results of ``one`` for each value; an error is a value of its row and fails no job."""
    found, errors = [], []
    for x in values.to_pylist():
        try:
            found.append(one(x))
            errors.append(None)
        except (ValueError, KeyError) as e:
            found.append(None)
            errors.append(str(e))
    return found, errors


def _per_row(df: DataFrame, ranks_path: str, encoding: str, key: str, column: Column, make, kind: pa.DataType, name: str, sql: str) -> DataFrame:
    """key, a result and an error (null where none) for each row."""

    def of(vocab: Vocabulary, values: pa.Array) -> Made:
        found, errors = _tried(values, lambda x: make(vocab, x))
        return pa.array(found, type=kind), errors

    return _in_parts(df, ranks_path, encoding, key, column, of, name, sql)


def encode(df: DataFrame, ranks_path: str, encoding: str = "r50k_base", key: str = "doc_id", text: str = "text", allowed: str | tuple[str, ...] = "none") -> DataFrame:
    """Per row: key, ids, error. A special token that ``allowed`` does not name is an error."""

    def of(vocab: Vocabulary, texts: pa.Array) -> Made:
        found, errors = _tried(texts, lambda t: np.array(vocab.encode(t or "", allowed), dtype=np.int32))
        some = [x for x in found if x is not None]
        flat = pa.array(np.concatenate(some) if some else np.zeros(0, dtype=np.int32))
        return of_lists(pa.int32(), [0 if x is None else len(x) for x in found], flat, [x is None for x in found]), errors

    return _in_parts(df, ranks_path, encoding, key, F.col(text).cast("string"), of, "ids", "array<int>")


_SPAN = pa.struct([("id", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])


def encode_spans(df: DataFrame, ranks_path: str, encoding: str = "r50k_base", key: str = "doc_id", text: str = "text", allowed: str | tuple[str, ...] = "none") -> DataFrame:
    """Per row: key, tokens (id, start, end, text; bytes of the text), error."""

    def make(vocab: Vocabulary, t: str | None) -> list[dict]:
        return [dict(zip(_SPAN.names, s, strict=True)) for s in vocab.spans(vocab.encode(t or "", allowed))]

    return _per_row(df, ranks_path, encoding, key, F.col(text).cast("string"), make, pa.list_(_SPAN), "tokens", "array<struct<id:int,start:bigint,end:bigint,text:string>>")


def decode(df: DataFrame, ranks_path: str, encoding: str = "r50k_base", key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: key, text, error; an id that the vocabulary lacks is an error, bytes that are no UTF-8 are replaced."""

    def of(vocab: Vocabulary, lists: pa.Array) -> Made:
        size, raw, _ = vocab.columns()
        flat = lists.flatten()
        known = flat.to_numpy(zero_copy_only=False) if pa.types.is_integer(flat.type) and not flat.null_count else np.full(1, -1)
        if len(known) and (known.min() < 0 or known.max() >= len(size) or size[known].min() < 0):
            found, errors = _tried(lists, lambda x: None if x is None else vocab.decode(x))
            return pa.array(found, type=pa.string()), errors
        data = raw.take(flat).buffers()[2] if len(known) else None
        data = data.to_pybytes() if data else b""
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(size[known])))[np.concatenate(([0], np.cumsum(lengths)))].tolist()
        found = [data[a:b].decode("utf-8", "replace") if ok else None for a, b, ok in zip(ends, ends[1:], lists.is_valid().to_pylist(), strict=False)]
        return pa.array(found, type=pa.string()), [None] * len(lists)

    return _in_parts(df, ranks_path, encoding, key, F.col(ids), of, "text", "string")


def encode_single_token(df: DataFrame, ranks_path: str, encoding: str = "r50k_base", key: str = "doc_id", token: str = "token") -> DataFrame:
    """Per row: key, id of the token that has exactly these bytes, error."""
    return _per_row(df, ranks_path, encoding, key, F.col(token).cast("binary"), lambda v, x: v.single(x or b""), pa.int32(), "id", "int")


# ---- tokens of clusters with provenance


def _title(name: str) -> str:
    return "".join(x.title() for x in name.split("_"))


class _Segment(NamedTuple):
    """A segment that has clusters: raw ranges of the first and the last one, and whether all are as in the raw text and none is left out."""

    map: TextMap
    provenance: str
    first: tuple[int, int]
    last: tuple[int, int]
    plain: bool


def _segment(text: str, provenance: str, form: str, strip: bool, base: int) -> _Segment | None:
    m = TextMap(text, form, strip, base)
    if not m.text:
        return None
    if m.text is not text:
        _, ranges = m.units()
        return _Segment(m, provenance, ranges[0], ranges[-1], False)
    end = base + (len(text) if text.isascii() else len(text.encode()))
    if text.isascii():
        first, last = text[:2] if text.startswith("\r\n") else text[0], text[-2:] if text.endswith("\r\n") else text[-1]
    else:
        first, *_, last = units if len(units := clusters(text)) > 1 else units * 2
    return _Segment(m, provenance, (base, base + len(first.encode())), (end - len(last.encode()), end), True)


class _Tokens(NamedTuple):
    """Tokens of one group: ids, raw starts and ends, and what holds for all of them."""

    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray
    provenance: str
    trust: str
    normalized: bool


def _trust(provenance: str) -> str:
    return TRUST[DEFAULT_TRUST.get(provenance, 0)]


def _group_tokens(vocab: Vocabulary, group: list[_Segment]) -> _Tokens:
    """Tokens of neighbouring segments, encoded as one text."""
    ids = np.array(vocab.ordinary("".join(g.map.text for g in group)), dtype=np.int32)
    ends = np.cumsum(vocab.columns()[0][ids])
    starts = np.concatenate(([0], ends[:-1])) if len(ids) else ends
    first, normalized = group[0].provenance, False
    if all(g.plain for g in group) and all(x.last[1] == y.first[0] for x, y in zip(group, group[1:], strict=False)):
        starts, ends = starts + group[0].first[0], ends + group[0].first[0]
    else:
        units = [(t, a, b, not g.plain and t.encode() != g.map.raw_bytes(a, b)) for g in group for t, a, b in g.map._walk()]
        normalized = any(u[3] for u in units)
        size = np.cumsum([0, *(len(u[0].encode()) for u in units)])
        low, high = np.array([u[1] for u in units]), np.array([u[2] for u in units])
        if normalized or (low[1:] != high[:-1]).any():
            starts, ends = low[np.searchsorted(size, starts, side="right") - 1], high[np.searchsorted(size, ends, side="left") - 1]
        else:
            starts, ends = starts + low[0], ends + low[0]
    return _Tokens(ids, starts, ends, first, _trust(first), normalized)


def merge_groups(vocab: Vocabulary, segments: list[tuple[str, str]], suppress: bool = True, form: str = "nfc", strip: bool = False) -> tuple[list[_Tokens], list[tuple]]:
    """Tokens by group of segments (text, provenance), and findings."""
    done, findings, group, base = [], [], [], 0
    for text, provenance in segments:
        s = _segment(text, provenance, form, strip, base)
        base += len(text) if text.isascii() else len(text.encode())
        if s is None:
            continue
        if group and provenance != group[-1].provenance:
            p, q = group[-1], s
            names = f"{_title(p.provenance)}→{_title(q.provenance)} (trust {_title(_trust(p.provenance))}→{_title(_trust(q.provenance))})"
            span = (min(p.last[0], q.first[0]), max(p.last[1], q.first[1]))
            if suppress:
                findings.append((*span, 1 if _trust(p.provenance) != _trust(q.provenance) else 0, "merge_boundary", 1.0, f"merge suppressed at provenance boundary {names}"))
                done.append(_group_tokens(vocab, group))
                group = []
            else:
                findings.append((*span, 3, "merge_boundary", 1.0, f"cross-provenance merge permitted by policy at {names}; token inherits {_title(p.provenance)} provenance over foreign bytes"))
        group.append(s)
    if group:
        done.append(_group_tokens(vocab, group))
    return done, findings


def merge_tokens(vocab: Vocabulary, segments: list[tuple[str, str]], suppress: bool = True, form: str = "nfc", strip: bool = False) -> tuple[list[tuple], list[tuple]]:
    """Tokens and findings of segments (text, provenance).

    Tokens are (id, text, start, end, provenance, trust, normalized, boundary).
    With ``suppress`` no token crosses a change of provenance, which gives a
    finding (low if trust changes, else none); without it one group of clusters
    is encoded as a whole and each crossing gives a finding of high severity.
    Ranges are raw bytes from the start of the first segment; where normal forms
    or stripping have changed the text, a token has the raw bytes of all clusters it touches.
    """
    groups, findings = merge_groups(vocab, segments, suppress, form, strip)
    text = vocab.columns()[2]
    return [t for g in groups for t in zip(g.ids.tolist(), text.take(pa.array(g.ids)).to_pylist(), g.start.tolist(), g.end.tolist(), *([x] * len(g.ids) for x in (g.provenance, g.trust, g.normalized, True)), strict=True)], findings


_TOKEN = pa.struct([("id", pa.int32()), ("text", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("provenance", pa.string()), ("trust", pa.string()), ("normalized", pa.bool_()), ("boundary", pa.bool_())])
_FOUND = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("rank", pa.int32()), ("detector", pa.string()), ("confidence", pa.float64()), ("evidence", pa.string())])
_MERGED_SQL = "struct<tokens:array<struct<id:int,text:string,start:bigint,end:bigint,provenance:string,trust:string,normalized:boolean,boundary:boolean>>,findings:array<struct<start:bigint,end:bigint,rank:int,detector:string,confidence:double,evidence:string>>>"


def merged(segments: DataFrame, ranks_path: str, key: str, order: str, encoding: str = "r50k_base", text: str = "text", provenance: str = "provenance", suppress: bool = True, form: str = "nfc") -> DataFrame:
    """Per key: tokens and merge findings of its segments in order. A key's segments are one input and come to one row."""

    def of(vocab: Vocabulary, rows: pa.Array) -> Made:
        done, errors = _tried(rows, lambda row: merge_groups(vocab, [(r["t"] or "", r["p"] or "unknown") for r in row], suppress, form))
        groups = [g for x in done if x for g in x[0]]
        many = [len(g.ids) for g in groups]
        ids = pa.array(np.concatenate([g.ids for g in groups]) if groups else np.zeros(0, dtype=np.int32))
        whole = lambda c: pa.array(np.concatenate([getattr(g, c) for g in groups]) if groups else np.zeros(0, dtype=np.int64), type=pa.int64())
        each = lambda c, kind: pa.array([getattr(g, c) for g in groups], type=kind).take(pa.array(np.repeat(np.arange(len(groups)), many)))
        # the boundary flag is that of a group's first cluster, which starts a segment
        columns = [ids, vocab.columns()[2].take(ids), whole("start"), whole("end"), each("provenance", pa.string()), each("trust", pa.string()), each("normalized", pa.bool_()), pa.array(np.ones(len(ids), dtype=bool))]
        gone = [x is None for x in done]
        tokens = of_lists(_TOKEN, [sum(len(g.ids) for g in x[0]) if x else 0 for x in done], pa.StructArray.from_arrays(columns, fields=list(_TOKEN)), gone)
        findings = pa.array([[dict(zip(_FOUND.names, f, strict=True)) for f in x[1]] if x else None for x in done], type=pa.list_(_FOUND))
        return pa.StructArray.from_arrays([tokens, findings], names=["tokens", "findings"], mask=pa.array(gone, type=pa.bool_()) if any(gone) else None), errors

    rows = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"), F.col(provenance).alias("p")))).alias("_parts"))
    out = _in_parts(rows, ranks_path, encoding, key, F.col("_parts"), of, "merged", _MERGED_SQL)
    return out.select(key, "merged.tokens", "merged.findings", "error")


def provenance_islands(segments: DataFrame, key: str, order: str, text: str = "text", provenance: str = "provenance") -> DataFrame:
    """Runs of neighbouring segments of one provenance; no token crosses from one to the next."""
    s = segments.selectExpr("*", f"case when {provenance} = lag({provenance}) over (partition by {key} order by {order}) then 0 else 1 end as _cut")
    s = s.selectExpr("*", f"sum(_cut) over (partition by {key} order by {order}) as island")
    parts = s.groupBy(key, "island").agg(F.first(provenance).alias("provenance"), F.count("*").alias("segments"), F.array_sort(F.collect_list(F.struct(order, text))).alias("t"))
    return parts.select(key, "island", "provenance", "segments", F.array_join(F.transform("t", lambda x: x[text]), "").alias("text"))


def boundary_findings(segments: DataFrame, key: str, order: str, rank: Column, suppress: bool = True, provenance: str = "provenance") -> DataFrame:
    """One finding for each change of provenance: low if trust changes, none else; high where merges may cross."""
    w = f"over (partition by {key} order by {order})"
    s = segments.withColumn("_trust", rank).selectExpr("*", f"lag({provenance}) {w} as before", f"lag(_trust) {w} as trust_before").where(f"before <> {provenance}")
    severity = F.when(F.lit(not suppress), 3).when(F.col("_trust") != F.col("trust_before"), 1).otherwise(0)
    return s.select(key, order, F.col("before").alias("from"), F.col(provenance).alias("to"), severity.alias("rank"))
