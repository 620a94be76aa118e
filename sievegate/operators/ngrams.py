"""Character n-grams: rare ones, entropy windows, slow-rate repetition across inputs."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import parts, short_batches
from ..functions.textmap import byte_offsets, code_points


def grams(text: Column, n: int = 4) -> Column:
    """All character n-grams in order; a text shorter than n has none."""
    # one linear pass of empty matches; substrings by place would cost the square of the length
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


class Grams(NamedTuple):
    """n-grams of one text: place of the first, how often, and share of all."""

    first: np.ndarray
    count: np.ndarray
    share: np.ndarray
    total: int


def _codes(chars: np.ndarray, n: int) -> np.ndarray:
    """A number for each n-gram of characters, equal only where the n-grams are."""
    total = len(chars) - n + 1
    top = int(chars.max())
    if top < 1 << 12:  # a table is faster than sorting
        here = np.zeros(top + 1, dtype=np.int64)
        here[chars] = 1
        many = int(here.sum())
        ids = (np.cumsum(here) - 1)[chars]
    else:
        letters, ids = np.unique(chars, return_inverse=True)
        many, ids = len(letters), ids.astype(np.int64)
    code, size = np.zeros(total, dtype=np.int64), 1
    for i in range(n):
        if size * many >= 1 << 62:  # too many for one number: name what there is so far
            _, code = np.unique(code, return_inverse=True)
            size = int(code.max()) + 1
        code, size = code * many + ids[i : i + total], size * many
    return code


def rare_of(text: str, n: int = 4, threshold: float = 0.02, chars: np.ndarray | None = None) -> Grams:
    """The n-grams below ``threshold`` of a text, by sorted codes; a text shorter than n has none. ``chars`` are its code points, if they are known."""
    chars = code_points(text) if chars is None else chars
    total = max(0, len(chars) - n + 1)
    if not total:
        return Grams(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), 0)
    code, bits = _codes(chars, n), total.bit_length()
    if int(code.max()) >> (62 - bits):
        _, first, count = np.unique(code, return_index=True, return_counts=True)
    else:  # code and place in one number
        key = np.sort(code << bits | np.arange(total))
        code = key >> bits
        at = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        first, count = key[at] & (1 << bits) - 1, np.diff(at, append=total)
    rare = count / total < threshold
    return Grams(first[rare], count[rare], count[rare] / total, total)


def _named(raw: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Array:
    """The strings between the places ``low`` and ``high`` of UTF-8 bytes."""
    ends = np.concatenate(([0], np.cumsum(high - low))).astype(np.int32)
    data = raw[np.arange(ends[-1]) + np.repeat(low - ends[:-1], high - low)]
    return pa.StringArray.from_buffers(len(low), pa.py_buffer(ends), pa.py_buffer(data))


def rare_grams(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, threshold: float = 0.02) -> DataFrame:
    """(key, gram, n, total, first) of the n-grams below ``threshold`` of their text, each counted within its row, so nothing is shuffled."""
    short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1 << 18):
                rows, raws, places, base = [], [], [], 0
                for r, t in enumerate(part.column(1).to_pylist()):
                    chars = code_points(t or "")
                    found = rare_of(t or "", n, threshold, chars)
                    if len(found.first):
                        at = byte_offsets(chars)
                        places.append((at[found.first] + base, at[found.first + n] + base))
                        raws.append(t.encode())
                        base += len(raws[-1])
                        rows.append((r, found))
                if rows:
                    many = [len(f.first) for _, f in rows]
                    names = _named(np.frombuffer(b"".join(raws), dtype=np.uint8), *(np.concatenate(x) for x in zip(*places, strict=True)))
                    keys = part.column(0).take(pa.array(np.repeat([r for r, _ in rows], many)))
                    count, first = (np.concatenate([f[k] for _, f in rows]) for k in (1, 0))
                    totals = np.repeat([f.total for _, f in rows], many)
                    yield pa.RecordBatch.from_arrays([keys, names, pa.array(count), pa.array(totals.astype(np.int32)), pa.array(first.astype(np.int32))], names=[key, "gram", "n", "total", "first"])

    return df.select(key, F.col(text).cast("string").alias("_t")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, gram string, n long, total int, first int")


def rare_stats(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, threshold: float = 0.02) -> DataFrame:
    """(key, rare, confidence) of the rows with rare n-grams."""
    short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rare_of(t.as_py() or "", n, threshold).share for t in batch.column(1)]
            some = pa.array([len(x) > 0 for x in found], type=pa.bool_())
            best = pa.array([round(1 - float(x.min()), 6) if len(x) else None for x in found], type=pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], type=pa.int64()), best], names=[key, "rare", "confidence"]).filter(some)

    return df.select(key, F.col(text).cast("string").alias("_t")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, rare long, confidence double")


def slow_rate(history: DataFrame, key: str, now: Column, window_s: int = 3600, most: int = 10) -> DataFrame:
    """Inputs in the window before ``now`` and whether they are too many; histories under three inputs have none."""
    g = history.groupBy(key).agg(F.count("*").alias("inputs"), F.count_if(F.col("at") >= now - window_s).alias("in_window"))
    n = F.when(F.col("inputs") < 3, 0).otherwise(F.col("in_window"))
    return g.select(key, n.alias("inputs_in_window"), (n > most).alias("rate_exceeded"))


#: A key with more inputs, or more bytes of them, is compared in pairs of blocks of about this size.
BLOCK_ROWS, BLOCK_BYTES = 128, 1 << 20


def shared_grams(texts: list[str], items: np.ndarray, blocks: np.ndarray, n: int = 4) -> Iterator[tuple[np.ndarray, ...]]:
    """(place of a, place of b, size of a, size of b, shared) of the pairs of texts with items a < b that share an n-gram; those of unlike blocks where there are two blocks.

    Inputs of one item and one size count as one, in which an n-gram stands as often as in them together.
    """
    many = np.array([max(0, len(t) - n + 1) for t in texts])
    if not many.sum():
        return
    chars = code_points("".join(texts))
    start = np.cumsum([0, *(len(t) for t in texts[:-1])])
    row = np.repeat(np.arange(len(texts)), many)
    _, gram = np.unique(_codes(chars, n)[np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + start[row]], return_inverse=True)
    distinct = int(gram.max()) + 1
    row, gram = np.divmod(np.unique(row * distinct + gram), distinct)
    size = np.bincount(row, minlength=len(texts))
    _, rank = np.unique(items, return_inverse=True)
    _, place, one = np.unique(np.stack([rank, size]), axis=1, return_index=True, return_inverse=True)
    one = one.reshape(-1)
    row, gram = (x[np.bincount(gram)[gram] > 1] for x in (row, gram))  # others are in one text only
    _, gram = np.unique(gram, return_inverse=True)
    shared, width = np.zeros((len(place), len(place))), max(1, (1 << 22) // len(place))
    order = np.argsort(gram, kind="stable")
    row, gram = row[order], gram[order]
    cuts = np.searchsorted(gram, np.arange(0, int(gram.max(initial=-1)) + 1 + width, width))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if a < b:
            held = np.zeros((len(place), int(gram[b - 1]) - k * width + 1))
            np.add.at(held, (one[row[a:b]], gram[a:b] - k * width), 1)
            shared += held @ held.T
    apart = blocks[place][:, None] != blocks[place][None, :]
    x, y = np.nonzero((shared > 0) & (rank[place][:, None] < rank[place][None, :]) & (apart | (blocks.min() == blocks.max())))
    yield place[x], place[y], size[place[x]], size[place[y]], shared[x, y].astype(np.int64)


def similar_inputs(history: DataFrame, key: str, item: str, text: str, n: int = 4, least: float = 0.3) -> DataFrame:
    """Pairs (a < b) of one key whose n-gram sets have Jaccard at least ``least``.

    The inputs of a key come together; those of a large key in pairs of blocks,
    so that no task holds more than two blocks and nothing is broadcast but the
    numbers of blocks of large keys.
    """
    short_batches(history.sparkSession)
    rows = history.select(F.col(key), F.col(item).alias("_i"), F.col(text).cast("string").alias("_t")).where(F.col(key).isNotNull() & F.col("_i").isNotNull() & (F.char_length("_t") >= n))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum(F.octet_length("_t")) / BLOCK_BYTES)).cast("int")
    large = rows.groupBy(key).agg(blocks.alias("_n")).where("_n > 1")
    rows = rows.join(F.broadcast(large), key, "left").withColumn("_n", F.coalesce("_n", F.lit(1))).withColumn("_b", F.pmod(F.xxhash64("_i"), F.col("_n")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    # equal items are in one block
    cells = rows.groupBy(key, F.least("_b", "_o").alias("_lo"), F.greatest("_b", "_o").alias("_hi")).agg(F.collect_list(F.struct("_i", "_t", "_b")).alias("_rows"))
    names = [key, "a", "b", "na", "nb", "shared"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                found = []
                for r, (cell, lo, hi) in enumerate(zip(part.column(1), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    items, texts, block = (cell.values.field(k) for k in range(3))
                    block = block.to_numpy(zero_copy_only=False)
                    if len(texts) < 2 or (lo < hi and block.min() == block.max()):
                        continue
                    for x, y, na, nb, k in shared_grams(texts.to_pylist(), items.to_numpy(zero_copy_only=False), block, n):
                        near = k >= least * (na + nb - k)
                        keys = part.column(0).take(pa.array(np.full(int(near.sum()), r)))
                        found.append(pa.RecordBatch.from_arrays([keys, items.take(pa.array(x[near])), items.take(pa.array(y[near])), *(pa.array(c[near]) for c in (na, nb, k))], names=names))
                if found:
                    yield from pa.Table.from_batches(found).combine_chunks().to_batches(max_chunksize=100_000)

    kind, of = history.schema[key].dataType.simpleString(), history.schema[item].dataType.simpleString()
    both = cells.select(key, "_rows", "_lo", "_hi").mapInArrow(run, f"`{key}` {kind}, a {of}, b {of}, na long, nb long, shared long")
    return both.select(key, "a", "b", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard"))


def slow_rate_severity(exceeded: Column, pairs: Column) -> Column:
    return F.when(exceeded & (pairs > 0), "high").when(exceeded | (pairs > 0), "medium").otherwise("none")


@functools.lru_cache(maxsize=8)
def _steps(window: int) -> np.ndarray:
    """What the sum of c * log2(c) gains when a count becomes c."""
    return np.array([0.0, *(c * np.log2(c) - (c - 1) * np.log2(max(c - 1, 1)) for c in range(1, window + 1))])


def entropy_profile(raw: bytes, window: int = 64, deviation: float = 3.0) -> tuple[float, float, float, int, list[tuple[int, float]]]:
    """Baseline, mean and peak of the windows' entropies, and (start, entropy) of windows far from the baseline."""
    data = np.frombuffer(raw, dtype=np.uint8)
    n = len(data)
    if not n:
        return 0.0, 0.0, 0.0, 0, []
    p = np.bincount(data, minlength=256)
    p = p[p > 0] / n
    base = float(-(p * np.log2(p)).sum())
    if n <= window:
        return base, base, base, 0, []
    # a byte that enters or leaves changes the sum of c * log2(c) by what its own count tells
    order = np.argsort(data, kind="stable")
    place = data[order].astype(np.int64) * (n + window + 1) + order
    step = _steps(window)
    before, after = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    low = np.searchsorted(place, place - window + 1)
    before[order] = np.arange(n) - low  # equal bytes among the window - 1 before
    after[order] = np.cumsum(np.bincount(low, minlength=n)) - np.arange(n)  # among itself and the window - 1 after, which have it in their windows before
    total = np.cumsum(step[before + 1])[window - 1 :]
    total[1:] -= np.cumsum(step[after[: n - window]])
    h = np.log2(window) - total / window
    odd = np.flatnonzero(np.abs(h - base) >= deviation)
    return base, float(h.mean()), float(max(h.max(), base)), len(odd), [(int(i), float(h[i])) for i in odd]


def entropy_profiles(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 64, deviation: float = 3.0) -> DataFrame:
    """Per row: key, baseline, average, peak, anomalies; texts in Arrow batches, prefix counts for each byte value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [entropy_profile((t.as_py() or "").encode(), window, deviation)[:4] for t in batch.column(1)]
            cols = [pa.array([round(f[i], 6) for f in found], type=pa.float64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array([f[3] for f in found], type=pa.int64())], names=[key, "baseline", "average", "peak", "anomalies"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string").alias("t")).mapInArrow(run, f"`{key}` {kind}, baseline double, average double, peak double, anomalies long")
