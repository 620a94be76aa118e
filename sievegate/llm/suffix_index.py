"""Substring dedup with a logarithmic family of suffix arrays.

A string of ``length`` bytes is repeated if it starts at two places of the
corpus. Every byte that a repeated string covers is removed, in every document.

Distribution. Each window of ``length`` bytes has one anchor: the leftmost
smallest hash of a ``gram``-byte window inside it. Equal windows have equal
anchors at equal distance, so only windows under the same anchor hash can be
equal. The windows of one anchor form one *context* (a stretch of text under
2 * length bytes). Contexts whose anchor hash occurs once are unique and leave
at once. Of the others one copy of each distinct context goes, by anchor hash,
to a partition with the number of its occurrences, and there through a family
of suffix arrays: each batch of contexts gets a suffix array, is merge-scanned
against the existing levels, and levels of equal size merge geometrically.
Anchor hashes only route; contexts are the same if their BLAKE2b digests
are, and windows are compared as bytes.

A hash with very many distinct contexts (a string in a large share of all
documents, with other surroundings each time) is dealt anew by narrower
contexts under longer keys, at last by single windows, so that no key has to
hold an unbounded group.

Defined cases: a null text is empty; texts shorter than ``length`` keep all;
rows with equal texts count as separate occurrences; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store, parts
from .texts import Rolling, U64, byte_view, chunks, sliding_argmin, tidied

LENGTH = 400
GRAM = 160
#: Distinct contexts under one key that one task compares; keys with more are dealt anew.
WIDE = 5_000
#: Bytes of contexts that get one suffix array, and bytes from which a family ends with its key.
BATCH = 1 << 20
FAMILY = 4 << 20


# ---------------------------------------------------------------- suffix arrays


class Level:
    """A suffix array over ``data``: the window starts ``order`` sorted by their ``length`` bytes; ``rank`` is equal for equal windows."""

    def __init__(self, data: np.ndarray, order: np.ndarray, new: np.ndarray, ids: np.ndarray) -> None:
        self.data, self.order, self.new, self.ids = data, order, new, ids

    @property
    def size(self) -> int:
        return len(self.order)


def words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a big-endian number; ``data`` has 8 more bytes at its end."""
    view = np.lib.stride_tricks.sliding_window_view(data, 8)
    return np.ascontiguousarray(view[at]).view(">u8").ravel().astype(U64)


def build(data: np.ndarray, starts: np.ndarray, ids: np.ndarray, length: int) -> Level:
    """Suffix array of the windows at ``starts`` by prefix doubling; only positions that still share a rank are sorted on. ``ids`` names each window for the caller."""
    if length < 8:
        raise ValueError("length must be 8 at least")
    n, have = len(data), 8
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    words = words_at(padded, np.arange(n))
    order = np.argsort(words)
    first = np.concatenate(([True], words[order][1:] != words[order][:-1]))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))  # the place of a group's first entry
    while have < length:
        tied = np.flatnonzero(~first | np.concatenate((~first[1:], [False])))
        if not len(tied):
            break
        step = min(have, length - have)
        at = order[tied]
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + after
        by = np.argsort(key)
        key, at = key[by], at[by]
        order[tied] = at
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        first[tied] = fresh
        rank[at] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        have += step
    key = rank[starts]
    by = np.argsort(key)
    key = key[by]
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(by) else np.zeros(0, dtype=bool)
    return Level(padded, starts[by], new, ids[by])


def merge(a: Level, b: Level, length: int) -> tuple[Level, np.ndarray]:
    """Merge-scan of two suffix arrays: the level of both, and for each of its entries whether the other side has an equal window.

    The sorted lists are merged by their first 8 bytes; only entries of groups
    that still hold both sides go on to the next 8.
    """
    shift = len(a.data)
    data = np.concatenate((a.data, b.data))
    pos = np.concatenate((a.order, b.order + shift))
    ids = np.concatenate((a.ids, b.ids))
    side = np.concatenate((np.zeros(a.size, dtype=bool), np.ones(b.size, dtype=bool)))
    own = np.concatenate((np.cumsum(a.new), np.cumsum(b.new) + a.size)).astype(np.int64)
    n = len(pos)
    order = np.arange(n)
    group = np.zeros(n, dtype=np.int64)  # by place in order
    todo = np.arange(n)  # places whose group holds both sides
    mixed = np.zeros(n, dtype=bool)
    done = 0
    while len(todo) and done < length:
        at = min(done, length - 8)
        key = words_at(data, pos[order[todo]] + at)
        by = np.lexsort((key, group[todo]))
        order[todo] = order[todo][by]
        key, g = key[by], group[todo]
        first = np.concatenate(([True], (key[1:] != key[:-1]) | (g[1:] != g[:-1])))
        group[todo] = todo[np.flatnonzero(first)][np.cumsum(first) - 1]
        done += 8
        label = np.cumsum(first) - 1
        sides = side[order[todo]]
        both = np.bincount(label, weights=sides, minlength=label[-1] + 1)
        count = np.bincount(label, minlength=label[-1] + 1)
        keep = ((both > 0) & (both < count))[label]
        todo = todo[keep]
    if len(todo):
        mixed[todo] = True
    cls = np.where(mixed, group, n + own[order])
    new = np.concatenate(([True], cls[1:] != cls[:-1])) if n else np.zeros(0, dtype=bool)
    return Level(data, pos[order], new, ids[order]), mixed


class IndexFamily:
    """Suffix arrays in levels of geometrically growing size; ``repeated`` tells which windows occur more than once."""

    def __init__(self, length: int = LENGTH) -> None:
        self.length, self.levels, self.repeated = length, [], np.zeros(0, dtype=bool)

    def add(self, data: np.ndarray, starts: np.ndarray, copied: np.ndarray | None = None) -> np.ndarray:
        """Index one more batch; gives the ids of its windows. Windows that are ``copied`` stand for several occurrences."""
        ids = np.arange(len(self.repeated), len(self.repeated) + len(starts))
        self.repeated = np.concatenate((self.repeated, np.zeros(len(starts), dtype=bool) if copied is None else copied))
        if not len(starts):
            return ids
        level = build(data, starts, ids, self.length)
        twin = ~level.new
        twin[:-1] |= ~level.new[1:]
        self.repeated[level.ids[twin]] = True
        slot, joined = level, None
        for old in self.levels:
            joined, mixed = merge(old, level, self.length)
            self.repeated[joined.ids[mixed]] = True
        while self.levels and self.levels[-1].size <= 2 * slot.size:
            old = self.levels.pop()
            slot = joined if slot is level and joined is not None else merge(old, slot, self.length)[0]
        self.levels.append(slot)
        return ids


# ---------------------------------------------------------------- per document


def _digest(data: bytes | np.ndarray, place: int = 0) -> bytes:
    """128 bits that stand for the bytes (and a place in them): a cryptographic hash, so that no input makes two strings one."""
    return hashlib.blake2b(data, digest_size=16, salt=place.to_bytes(4, "little")).digest()


def _occurrences(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        w = length - gram + 1
        for batch in batches:
            data, off = byte_view(batch.column(0))
            for i, j in chunks(off):
                sub, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                if len(sub) < length:
                    continue
                keys = np.zeros((j - i, 2), dtype=np.int64)
                use = np.zeros(j - i, dtype=bool)
                for r in np.flatnonzero(np.diff(o) >= length):
                    digest = _digest(sub[o[r] : o[r + 1]])
                    seen[digest] = times = seen.get(digest, 0) + 1
                    use[r] = times <= 2  # a third copy in this task tells nothing new
                    keys[r] = np.frombuffer(digest, dtype=np.int64)
                hashes = Rolling(sub)
                grams = hashes.grams(gram)
                anchor = sliding_argmin(grams, w)
                row = np.repeat(np.arange(j - i), np.diff(o))[: len(anchor)]
                idx = np.flatnonzero(use[row] & (np.arange(len(anchor)) + length <= o[row + 1]))
                if not len(idx):
                    continue
                a, r = anchor[idx], row[idx]
                cut = np.flatnonzero((a[1:] != a[:-1]) | (r[1:] != r[:-1]))
                lo, hi = idx[np.concatenate(([0], cut + 1))], idx[np.concatenate((cut, [len(idx) - 1]))]
                row, at = row[lo], anchor[lo]
                raw = sub.tobytes()
                context = b"".join([_digest(raw[i:j], m) for i, j, m in zip(lo.tolist(), (hi + length).tolist(), (at - lo).tolist(), strict=True)])
                context = np.frombuffer(context, dtype=np.int64).reshape(-1, 2)
                base = o[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[row, 0]), pa.array(keys[row, 1]), pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32)), pa.array((at - base).astype(np.int32)), pa.array(grams[at].view(np.int64)), pa.array(context[:, 0].copy()), pa.array(context[:, 1].copy())],
                    names=["t1", "t2", "lo", "hi", "at", "key", "c1", "c2"],
                )

    return tidied(run)


def _distinct_texts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            column = batch.column(0)
            data, off = byte_view(column)
            keys, rows = [], []
            for r in np.flatnonzero(np.diff(off) >= length):
                digest = _digest(data[off[r] : off[r + 1]])
                if digest not in seen:
                    seen.add(digest)
                    rows.append(r)
                    keys.append(digest)
            pair = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), column.take(pa.array(rows, type=pa.int64()))], names=["t1", "t2", "text"])

    return tidied(run)


def _plain(names: list[str], length: int):
    """Per row: the other columns, the text's key, its size and the digest of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = byte_view(batch.column(batch.num_columns - 1))
            keys, shas = [], []
            for r in range(batch.num_rows):
                text = data[off[r] : off[r + 1]]
                keys.append(_digest(text))
                shas.append(hashlib.sha256(text).hexdigest())
            pair = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(np.diff(off)), pa.array(shas)], names=[*names, "t1", "t2", "n_bytes", "sha"])

    return tidied(run)


def _cut_contexts(length: int, width: int, full: int):
    """From a text and its wanted contexts to stretches of ``width`` windows at most, each under a key of its common bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = byte_view(batch.column(0))
            out: dict[str, list] = {k: [] for k in _CUT}
            size = 0
            for r, wanted in enumerate(batch.column(1).to_pylist()):
                text = data[off[r] : off[r + 1]]
                for want in wanted:
                    lo, hi, at = want["lo"], want["hi"], want["at"]
                    if width >= full:
                        cuts = [(lo, hi, want["key"])]
                    else:
                        # by distance to the anchor, so that equal windows fall into equal parts
                        cuts = []
                        for d in range((at - hi) // width, (at - lo) // width + 1):
                            i, j = max(lo, at - (d + 1) * width + 1), min(hi, at - d * width)
                            if i <= j:
                                core = text[at - d * width : at - (d + 1) * width + 1 + length]
                                cuts.append((i, j, _signed(xxhash.xxh3_64_intdigest(core, seed=d + 1))))
                    for i, j, key in cuts:
                        stretch = text[i : j + length].tobytes()
                        p1, p2 = np.frombuffer(_digest(stretch, at - i + length), dtype=np.int64).tolist()
                        for k, v in zip(_CUT, (key, want["c1"], want["c2"], i - lo, p1, p2, want["times"], stretch), strict=True):
                            out[k].append(v)
                        size += len(stretch)
                    if size > 1 << 20:
                        yield _context_batch(out)
                        out, size = {k: [] for k in out}, 0
            yield _context_batch(out)

    return tidied(run)


_CUT = {"key": pa.int64(), "c1": pa.int64(), "c2": pa.int64(), "first": pa.int32(), "p1": pa.int64(), "p2": pa.int64(), "times": pa.int64(), "bytes": pa.binary()}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _context_batch(out: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, type=_CUT[k]) for k, v in out.items()], names=list(out))


def _index_partition(length: int, batch_bytes: int, family_bytes: int):
    """From rows (key, p1, p2, times, bytes) sorted by key: the repeated window ranges of each, by an index family.

    Only windows under one key can be equal, so a family that has grown to
    ``family_bytes`` ends with its last key and another one begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, held, size = IndexFamily(length), [], 0
        names, blobs, times, total, last = [], [], [], 0, None

        def add() -> None:
            nonlocal names, blobs, times, total
            if blobs:
                sizes = np.array([len(x) for x in blobs])
                base = np.cumsum(sizes) - sizes
                counts = sizes - length + 1
                first = np.cumsum(counts) - counts
                starts = np.arange(counts.sum()) + np.repeat(base - first, counts)
                ids = family.add(np.frombuffer(b"".join(blobs), dtype=np.uint8), starts, np.repeat(np.array(times) > 1, counts))
                held.append((np.array(names), counts, first + ids[0]))
            names, blobs, times, total = [], [], [], 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal family, held, size
            add()
            for parts_, counts, first in held:
                ranges = []
                for n, f in zip(counts, first, strict=True):
                    flags = np.concatenate(([False], family.repeated[f : f + n], [False]))
                    ranges.append(np.flatnonzero(flags[1:] != flags[:-1]).astype(np.int32))
                some = np.array([len(x) > 0 for x in ranges])
                yield pa.RecordBatch.from_arrays([pa.array(parts_[some, 0].copy()), pa.array(parts_[some, 1].copy()), pa.array([x for x in ranges if len(x)], type=pa.list_(pa.int32()))], names=["p1", "p2", "ranges"])
            family, held, size = IndexFamily(length), [], 0

        for batch in batches:
            for key, p1, p2, many, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= family_bytes and key != last:
                    yield from done()
                last = key
                names.append((p1, p2))
                blobs.append(blob)
                times.append(many)
                total += len(blob)
                size += len(blob)
                if total >= batch_bytes:
                    add()
        yield from done()

    return tidied(run)


def _apply(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = byte_view(batch.column(2))
            removed, spans, shas, kept = [], [], [], []
            flat = batch.column(3)
            for r in range(batch.num_rows):
                text = data[off[r] : off[r + 1]]
                runs = np.sort(np.frombuffer(np.array(flat[r].as_py(), dtype=np.int64), dtype=np.int64).reshape(-1, 2), axis=0)
                keep = np.ones(len(text) + 1, dtype=bool)
                step = np.zeros(len(text) + 1, dtype=np.int64)
                np.add.at(step, runs[:, 0], 1)
                np.add.at(step, runs[:, 1], -1)
                keep = np.cumsum(step)[: len(text)] == 0
                left = text[keep].tobytes()
                cut = np.concatenate(([True], keep, [True]))
                removed.append(len(text) - len(left))
                spans.append(int((cut[:-1] & ~cut[1:]).sum()))
                shas.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, type=pa.int64()), pa.array(spans, type=pa.int64()), pa.array(shas, type=pa.string()), pa.array(kept, type=pa.binary())], names=["t1", "t2", "n_removed", "n_spans", "kept_sha", "kept"])

    return tidied(run)


# ---------------------------------------------------------------- the operator


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, wide: int = WIDE, batch_bytes: int = BATCH, family_bytes: int = FAMILY, keep_text: bool = False) -> DataFrame:
    """Per row of ``docs``: key, n_bytes, n_removed, n_spans, kept_sha256, has_repeats (any byte is removed) and, with ``keep_text``, the remaining bytes as ``kept``.

    ``kept`` is binary, since a removed run may end inside a character; it is
    null for rows that keep everything. See the module for method and cases.
    """
    if not 8 <= gram <= length:
        raise ValueError("gram must lie between 8 and length")
    spark = docs.sparkSession
    store, n = Store(spark, "suffix"), parts(spark)
    docs = docs.select(F.col(key).alias("row_key"), F.col(text).cast("string").alias("row_text"))
    only = docs.select("row_text")
    full = length - gram + 1

    seen = store.put("all", only.mapInArrow(_occurrences(length, gram), "t1 long, t2 long, lo int, hi int, at int, key long, c1 long, c2 long"))
    # written first, so that the join deals both sides itself and may split a hot hash
    again = store.put("again", seen.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    hits = store.put("hits", seen.join(again, "key"))
    store.drop("all")

    texts = only.mapInArrow(_distinct_texts(length), "t1 long, t2 long, text string")
    texts = store.put("texts", texts.join(hits.select("t1", "t2").distinct(), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"]))

    # one copy of each context that shares its anchor hash with other occurrences, and how often it occurs
    reps = hits.groupBy("key", "c1", "c2").agg(F.min(F.struct("t1", "t2", "lo", "hi", "at")).alias("x"), F.count("*").alias("times")).select("key", "c1", "c2", "times", "x.*")
    found = None
    for depth, width in enumerate((full, 16, 1)):
        if width > full:
            continue
        wanted = reps.groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "hi", "at", "key", "c1", "c2", "times")).alias("wanted"))
        cut = texts.join(wanted, ["t1", "t2"]).select("text", "wanted").mapInArrow(_cut_contexts(length, width, full), "key long, c1 long, c2 long, first int, p1 long, p2 long, times long, bytes binary")
        cut = store.put(f"cut{depth}", cut)
        sizes = cut.groupBy("key", "p1", "p2").agg(F.sum("times").alias("times")).groupBy("key").agg(F.count("*").alias("parts"), F.sum("times").alias("uses"))
        sizes = store.put(f"sizes{depth}", sizes.where("uses > 1"))
        hot = store.put(f"hot{depth}", sizes.where(F.lit(width > 1) & (F.col("parts") > wide)).select("key"))
        more = not hot.isEmpty()
        if depth:
            once = cut.join(sizes.join(hot, "key", "left_anti").select("key"), "key", "left_semi")
            uses = once.groupBy("key", "p1", "p2").agg(F.sum("times").alias("times"), F.first("bytes").alias("bytes"))
        else:  # each context is one row, and each key has several uses
            once = uses = cut.join(hot, "key", "left_anti") if more else cut
        # twice the usual partitions: suffix arrays take some tens of bytes for each byte
        indexed = uses.repartition(2 * n, "key").sortWithinPartitions("key").select("key", "p1", "p2", "times", "bytes").mapInArrow(_index_partition(length, batch_bytes, family_bytes), "p1 long, p2 long, ranges array<int>")
        # equal parts are equal stretches at equal places to their anchors
        repeated = store.put(f"ranges{depth}", indexed)
        here = store.put(f"found{depth}", once.select("c1", "c2", "key", "first", "p1", "p2").join(repeated, ["p1", "p2"]).select("c1", "c2", "first", "ranges"))
        found = here if found is None else found.unionByName(here)
        if not more:
            break
        inside = cut.join(hot, "key", "left_semi").select("c1", "c2").distinct()
        reps = store.put(f"reps{depth}", reps.join(inside, ["c1", "c2"], "left_semi"))

    each = found.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("ranges") - 2, F.lit(2)))).select("c1", "c2", (F.col("first") + F.element_at("ranges", F.col("i") + 1)).alias("from"), (F.col("first") + F.element_at("ranges", F.col("i") + 2) - 1).alias("to"))
    # written first, so that the join deals both sides itself and may split a hot context
    each = store.put("each", each.groupBy("c1", "c2").agg(F.collect_set(F.struct("from", "to")).alias("runs")))
    some = hits.select("c1", "c2", "t1", "t2", "lo").distinct().join(each, ["c1", "c2"]).select("t1", "t2", F.explode("runs").alias("r"), "lo").select("t1", "t2", (F.col("lo") + F.col("r.from")).alias("start"), (F.col("lo") + F.col("r.to") + length).alias("stop"))
    runs = some.groupBy("t1", "t2").agg(F.flatten(F.collect_list(F.array(F.col("start").cast("long"), F.col("stop").cast("long")))).alias("runs"))
    result = texts.join(runs, ["t1", "t2"]).select("t1", "t2", "text", "runs").mapInArrow(_apply(length), "t1 long, t2 long, n_removed long, n_spans long, kept_sha string, kept binary")
    result = store.put("result", result if keep_text else result.drop("kept"))
    store.drop("again", "hits", "texts", "each", *(f"{k}{depth}" for k in ("cut", "sizes", "ranges", "found", "hot", "reps") for depth in range(3)))

    kind = docs.schema["row_key"].dataType.simpleString()
    rows = docs.mapInArrow(_plain(["row_key"], length), f"row_key {kind}, t1 long, t2 long, n_bytes long, sha string")
    removed = F.coalesce("n_removed", F.lit(0)).cast("long")
    return rows.join(result, ["t1", "t2"], "left").select(
        F.col("row_key").alias(key), "n_bytes", removed.alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha", "sha").alias("kept_sha256"), (removed > 0).alias("has_repeats"), *(["kept"] if keep_text else []),
    )


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The same result by a dictionary of all strings, for tests."""
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for t in raw:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in raw:
        keep = [True] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                keep[i : i + length] = [False] * length
        spans = sum(1 for i, k in enumerate(keep) if not k and (i == 0 or keep[i - 1]))
        left = bytes(b for b, k in zip(t, keep, strict=True) if k)
        out.append((len(t), len(t) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return out
