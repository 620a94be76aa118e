"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into windows (``SPAN`` bytes, a new one every ``STEP``,
the last at the item's end; an item shorter than that is one window) with an
edit budget of ``RATE``. A text region within k edits of a window of n bytes
shares at least n + 1 - q - k * q of its q-grams, and their diagonals (place in
the text less place in the window) spread over k at most. So shared q-grams are
counted in overlapping diagonal bands of twice that width, bands that meet the
bound are retained, and a banded alignment verifies them.

Both sides are read with A-Z lowered and runs of white space as one space.
An item is found in a text if one of its windows is; windows of items with
fewer than q bytes are none, as such items say nothing about a leak.

Defined cases: null and empty texts are clean; null items are ignored; repeated
rows each get their result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store, bounded_batches, free_name
from .texts import U64, byte_view, chunks, lower_ascii, tidied

Q = 8
SPAN = 96
STEP = 32
RATE = 0.05
#: Bytes of items that go to all tasks at once (their index takes some 70 times as much); more are taken in blocks, a pass over the documents for each.
BLOCK = 2 << 20
#: Hit positions that are counted at once.
HITS = 200_000
_BITS = 22
_ODD = U64(0x9E3779B97F4A7C15)


def normal_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = lower_ascii(data)
    blank = (low == 32) | ((low >= 9) & (low <= 13))
    low[blank] = 32
    start = np.zeros(len(low) + 1, dtype=bool)
    start[offsets] = True
    keep = ~(blank & np.concatenate(([False], blank[:-1])) & ~start[:-1])
    return low[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]


def grams_of(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a number."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    return np.array(np.ndarray(shape=(n,), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,)), dtype=U64)


def edits(window: bytes, region: bytes, most: int, start: int) -> int:
    """Fewest edits from ``window`` to a part of ``region``, within ``most`` diagonals of ``start``; most + 1 if there are more."""
    if window in region:
        return 0
    width = 2 * most + 1 + len(region) - len(window) - start if len(region) > len(window) + start else 2 * most + 1
    low = start - most
    row = [0] * (width + 1)
    big = most + 1
    for i, c in enumerate(window):
        new = [big] * (width + 1)
        least = big
        for k in range(width):
            j = i + low + k  # place in region
            best = row[k] + (not (0 <= j < len(region) and region[j] == c))  # match or replace
            if k + 1 <= width and row[k + 1] + 1 < best:  # a byte of the window is missing
                best = row[k + 1] + 1
            if k and new[k - 1] + 1 < best:  # a byte too many
                best = new[k - 1] + 1
            if best > big:
                best = big
            new[k] = best
            if best < least:
                least = best
        if least > most:
            return big
        row = new
    return min(row)


class Needles:
    """The windows of a block of items and an index of their q-grams."""

    def __init__(self, items: list[tuple[int, str | None]], span: int = SPAN, step: int = STEP, rate: float = RATE) -> None:
        self.item, self.text, self.most, self.bound = [], [], [], []
        grams, owner, place = [], [], []
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
            data, _ = normal_bytes(raw, np.array([0, len(raw)]))
            data = np.frombuffer(data.tobytes().strip(), dtype=np.uint8)
            n = len(data)
            if n < Q:
                continue
            starts = sorted({*range(0, max(n - span, 0), step), max(n - span, 0)})
            for s in starts:
                window = data[s : s + span]
                most = min(int(rate * len(window)), (len(window) - Q) // Q)
                grams.append(grams_of(window))
                owner.append(np.full(len(grams[-1]), len(self.item)))
                place.append(np.arange(len(grams[-1])))
                self.item.append(item)
                self.text.append(window.tobytes())
                self.most.append(most)
                self.bound.append(len(window) + 1 - Q - most * Q)
        self.many = len(self.item)
        if not self.many:
            return
        grams, owner, place = np.concatenate(grams), np.concatenate(owner), np.concatenate(place)
        order = np.argsort(grams, kind="stable")
        self.owner, self.place = owner[order].astype(np.int64), place[order].astype(np.int64)
        self.grams, self.first = np.unique(grams[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))
        self.map = np.zeros(1 << _BITS, dtype=bool)
        self.map[(self.grams * _ODD) >> U64(64 - _BITS)] = True
        self.most, self.bound = np.array(self.most), np.array(self.bound)
        self.longest = max(len(x) for x in self.text) + int(self.most.max())

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, window, place in the normal text, edits) of each verified band."""
        data, offsets = normal_bytes(data, offsets)
        if not self.many or len(data) < Q:
            return []
        grams = grams_of(data)
        hit = self.map[(grams * _ODD) >> U64(64 - _BITS)]
        at = np.flatnonzero(hit)
        at = at[self.grams[np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)] == grams[at]]
        # a region needs at least the smallest bound of hits within the longest window and its budget
        need, reach = int(self.bound.min()), self.longest
        if len(at) < need:
            return []
        dense = at[need - 1 :] - at[: len(at) - need + 1] < reach
        use = np.zeros(len(at) + 1, dtype=np.int64)
        starts = np.flatnonzero(dense)
        np.add.at(use, starts, 1)
        np.add.at(use, starts + need, -1)
        at = at[np.cumsum(use)[:-1] > 0]
        if not len(at):
            return []
        found = []
        # pieces of many hits overlap by more than a band reaches, so each band is whole in one of them
        for i in range(0, len(at), HITS):
            last = at[min(i + HITS, len(at)) - 1]
            end = np.searchsorted(at, last + self.longest + int(self.most.max()) + Q, side="right")
            found += self._bands(data, offsets, grams, at[i:end])
        return sorted(set(found))

    def _bands(self, data, offsets, grams, at) -> list[tuple[int, int, int, int]]:
        slot = np.searchsorted(self.grams, grams[at])
        many = self.last[slot] - self.first[slot]
        where = np.repeat(at, many)
        entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - self.first[slot], many)
        owner, place = self.owner[entry], self.place[entry]
        row = np.searchsorted(offsets, where, side="right") - 1
        diagonal = where - place + len(data)  # positive
        width = self.most[owner] + 1
        band = diagonal // width
        out = []
        for shift in (0, 1):  # bands of twice the width, starting at every width
            b = band - shift
            order = np.lexsort((place, b, owner, row))
            r, o, d, p = row[order], owner[order], b[order], place[order]
            new = np.concatenate(([True], (r[1:] != r[:-1]) | (o[1:] != o[:-1]) | (d[1:] != d[:-1])))
            fresh = new | np.concatenate(([True], p[1:] != p[:-1]))
            group = np.cumsum(new) - 1
            count = np.bincount(group, weights=fresh)
            first = np.flatnonzero(new)
            if shift == 0:
                keep0 = [(r[first], o[first], d[first], count)]
            else:
                keep0.append((r[first], o[first], d[first], count))
        r, o, d, c = (np.concatenate(x) for x in zip(*keep0, strict=True))
        order = np.lexsort((d, o, r))
        r, o, d, c = r[order], o[order], d[order], c[order]
        new = np.concatenate(([True], (r[1:] != r[:-1]) | (o[1:] != o[:-1]) | (d[1:] != d[:-1])))
        first = np.flatnonzero(new)
        total = np.add.reduceat(c, first)
        for f in first[total >= self.bound[o[first]]]:
            w, k = int(o[f]), int(self.most[o[f]])
            start = int(d[f]) * (k + 1) - len(data)
            low, high = int(offsets[r[f]]), int(offsets[r[f] + 1])
            begin = max(low, start - k)
            region = data[begin : min(high, start + 2 * (k + 1) + len(self.text[w]) + k)].tobytes()
            e = edits(self.text[w], region, 2 * k + 2, max(0, start + k + 1 - begin))
            if e <= k:
                out.append((int(r[f]), w, max(start, low) - low, e))
        return out


def _find(needles: Needles, give: str):
    """The last column is searched. ``keep``: rows without a find, less that column; ``add``: all rows, with what was found in its place; ``hits``: only those with a find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = byte_view(batch.column(batch.num_columns - 1))
            items: list[set[int]] = [set() for _ in range(batch.num_rows)]
            spans = [0] * batch.num_rows
            for i, j in chunks(off):
                for r, w, _, _ in needles.find(data[off[i] : off[j]], off[i : j + 1] - off[i]):
                    items[i + r].add(needles.item[w])
                    spans[i + r] += 1
            rest, names = batch.columns[:-1], batch.schema.names[:-1]
            if give == "keep":
                yield batch.filter(pa.array([not x for x in items], type=pa.bool_())).select(range(batch.num_columns - 1))
                continue
            out = pa.RecordBatch.from_arrays([*rest, pa.array([sorted(x) for x in items], type=pa.list_(pa.int64())), pa.array(spans, type=pa.int64())], names=[*names, "_items", "_windows"])
            yield out.filter(pa.array([bool(x) for x in items], type=pa.bool_())) if give == "hits" else out

    return tidied(run)


def _blocks(items: DataFrame, key: str, text: str, limit: int) -> Iterator[Needles]:
    """The items in blocks of bounded size; only one block is on the driver at a time."""
    block, size = [], 0
    for row in items.select(F.col(key).cast("long"), F.col(text).cast("string")).where(F.col(text).isNotNull()).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1].encode())
        if size >= limit:
            yield Needles(block)
            block, size = [], 0
    if block:
        yield Needles(block)


def _single(items: DataFrame, text: str, limit: int) -> bool:
    return (items.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0) < limit


def _passes(docs: DataFrame, items: DataFrame, text: str, item_key: str, item_text: str, block: int) -> tuple[Store, DataFrame]:
    """A pass over the documents for each block of items; gives (digest of the text, items found, windows found) of the texts with any."""
    store, found = Store(docs.sparkSession, "leaks"), None
    scan = docs.select(F.sha2(F.col(text).cast("string"), 256).alias("digest"), F.col(text).cast("string").alias("_scan")).where("_scan is not null")
    for i, needles in enumerate(_blocks(items, item_key, item_text, block)):
        hits = scan.mapInArrow(_find(needles, "hits"), "digest string, _items array<long>, _windows long")
        hits = store.put(f"block{i}", hits.dropDuplicates(["digest"]))
        found = hits if found is None else found.unionByName(hits)
    return store, found.groupBy("digest").agg(F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items"), F.sum("_windows").alias("_windows"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` in whose text no window of an item is found, with all columns."""
    bounded_batches(docs.sparkSession)
    scan = free_name(docs, "_scan")
    if _single(items, item_text, block):
        for needles in _blocks(items, item_key, item_text, block):
            docs = docs.withColumn(scan, F.col(text).cast("string")).mapInArrow(_find(needles, "keep"), docs.schema)
        return docs
    _, found = _passes(docs, items, text, item_key, item_text, block)
    found = found.select(F.col("digest").alias(scan))
    return docs.withColumn("_d" + scan, F.sha2(F.col(text).cast("string"), 256)).join(found, F.col("_d" + scan) == F.col(scan), "left_anti").select(*docs.columns)


def find_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row: key, contaminated, n_items, items (sorted ids of the items found) and n_windows (windows found).

    Items up to ``block`` bytes go to all tasks at once, in one pass without a
    shuffle. More are taken in blocks: each pass has one block in its plan and
    leaves a table of the texts found, by digest, which is joined at the end.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_scan"))
    none = (F.array().cast("array<bigint>").alias("_items"), F.lit(0).cast("long").alias("_windows"))
    if _single(items, item_text, block):
        done = rows.select("_key", *none)
        for needles in _blocks(items, item_key, item_text, block):
            done = rows.mapInArrow(_find(needles, "add"), done.schema)
    else:
        _, found = _passes(docs, items, text, item_key, item_text, block)
        rows = rows.select("_key", F.sha2("_scan", 256).alias("digest")).join(found, "digest", "left")
        done = rows.select("_key", F.coalesce("_items", none[0]).alias("_items"), F.coalesce("_windows", none[1]).alias("_windows"))
    return done.select(F.col("_key").alias(key), (F.size("_items") > 0).alias("contaminated"), F.size("_items").cast("long").alias("n_items"), F.array_sort("_items").alias("items"), F.col("_windows").alias("n_windows"))
