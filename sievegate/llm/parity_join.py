"""N-gram Jaccard join with parity sketches.

A document's set is its distinct word shingles. A parity sketch XORs a hash of
every shingle into one of m parts, so two sketches differ in at most as many
parts as the symmetric difference has members. Sets a, b with Jaccard at least
t have a symmetric difference of at most (|a| + |b|) * (1 - t) / (1 + t); with
more parts than that, one part at least is equal (pigeonhole). Sizes fall into
bands, each with its own m; a set also takes part in the next band if a partner
there is possible. Documents that share a part are candidates.

A part with fewer than ``INFO`` shingles says little and would put strangers
together. A set sends its first rich parts, one more than its symmetric
difference to a partner can be; of two similar sets, the one whose parts end
first has a match among them, which the other sends too. A set with too few
rich parts sends all parts: of a similar pair either one side has rich parts
enough, which then match, or both send all.

Candidates of one part are first compared with its smallest set only, by size
and by parity sketches whose length follows the set's size. Of the pairs that
stay near, the nearest of each set is verified first and those links make
components; the others are verified where their ends are in different
components by then. So every pair with a part's smallest set is settled.

Parts whose other sets then still belong to several components form families
(components of what shares a part). A family's sets are dealt to blocks of
``FAMILY_BLOCK``, and a task compares two blocks: pairs across components by a
second, longer parity sketch, verified where that allows; a pair that is
connected by then is passed over. A family of more than ``FAMILY`` sets or
``FAMILY_BYTES`` is compared part by part instead, a part's sets dealt to blocks
of ``PART_BLOCK``, and its near pairs are settled as above. Both ways compare every pair of
sets that share a part and are not connected, so every link that joins two
components is found, while groups of copies never become pairs. Equal sets are
one node throughout.

Defined cases: texts that are null or have no word have an empty set and link
with nothing; texts shorter than a shingle are one shingle; rows with a null
key get a component of null and the smallest key of a class is taken among the
others; repeated keys are one document; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import Store, parts
from .texts import Rolling, U64, byte_view, chunks, lower_ascii, mix64, tidied, words

RATIO = 1.6
INFO = 2
#: Bits of the shortest sketches.
SKETCH_BITS = 512
#: Sets, and bytes of their shingles, of families that are compared as a whole; larger ones are compared part by part.
FAMILY = 20_000
FAMILY_BYTES = 32 << 20
#: Sets of a family, and of a part, in one block; a task compares two blocks.
FAMILY_BLOCK = 1024
PART_BLOCK = 2048


# ---------------------------------------------------------------- sets


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their rows, in text order; a row with fewer than ``k`` words has one of all its words."""
    low = lower_ascii(data)
    start, stop, row = words(low, offsets)
    n_rows = len(offsets) - 1
    if not len(start):
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    word = Rolling(low).of(start, stop)
    per_row = np.bincount(row, minlength=n_rows)
    n = len(word)
    value = np.zeros(max(n - k + 1, 0), dtype=U64)
    for i in range(k):
        value = mix64(value + word[i : n - k + 1 + i] * U64(2 * i + 1)) if len(value) else value
    full = row[: len(value)] == row[k - 1 : k - 1 + len(value)] if len(value) else np.zeros(0, dtype=bool)
    value, at = value[full], row[: len(full)][full]
    short = np.flatnonzero((per_row > 0) & (per_row < k))
    if len(short):
        first = np.searchsorted(row, short)
        extra = []
        for f, m in zip(first, per_row[short], strict=True):
            v = np.full(1, m, dtype=U64)
            for i in range(m):
                v = mix64(v + word[f + i : f + i + 1] * U64(2 * i + 1))
            extra.append(mix64(v ^ U64(0x5851F42D4C957F2D)))
        value, at = np.concatenate((value, *extra)), np.concatenate((at, short))
        order = np.argsort(at, kind="stable")
        value, at = value[order], at[order]
    return value, at


def sets_of(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row."""
    data, off = byte_view(column)
    for i, j in chunks(off):
        value, at = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
        cut = np.searchsorted(at, np.arange(j - i + 1))
        for r in range(j - i):
            yield i + r, np.unique(value[cut[r] : cut[r + 1]])


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a, b = mix64(s).sum(dtype=U64), mix64(s ^ U64(0xA0761D6478BD642F)).sum(dtype=U64)
    n = np.array([len(s)], dtype=U64)
    a, b = mix64(np.concatenate((n + a, n * U64(0x9E3779B97F4A7C15) ^ b))).view(np.int64)
    return int(a), int(b)


def small_sketch(s: np.ndarray) -> bytes:
    """Each shingle flips one bit, of as many bits as the set has members or somewhat more."""
    bits = max(SKETCH_BITS, 1 << (len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch of ``size`` bytes of the same set."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, dtype=U64).reshape(-1, size // 8), axis=0)


# ---------------------------------------------------------------- bands and parts


class Bands:
    """Size bands for Jaccard >= num / den: for each its bounds and its number of parts."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.low = [1]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * RATIO)))
        self.starts = np.array(self.low)
        self._parts: dict[int, tuple[int, int]] = {}

    def most(self, total: int) -> int:
        """The largest symmetric difference of a similar pair whose sizes sum to ``total``."""
        return total * (self.den - self.num) // (self.den + self.num)

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    def parts(self, band: int) -> tuple[int, int]:
        """Number of parts, and shingles that make a part count; 0 parts: only equal sets are similar."""
        if band not in self._parts:
            low, high = self.low[band], self.low[band + 1] - 1
            most = self.most(2 * high)
            # five to six shingles a part at the low end, with parts to spare for those that say little
            self._parts[band] = (0, 1) if most == 0 else (most + 2, 1) if most < 8 else (max(most + 2, int(low / 5.5)) + 2, INFO)
        return self._parts[band]

    def joins(self, n: int) -> list[int]:
        b = self.band(n)
        return [b, b + 1] if n * self.den // self.num >= self.low[b + 1] else [b]

    def keys(self, s: np.ndarray) -> np.ndarray:
        """The part keys that a set sends."""
        n, out = len(s), []
        for j in self.joins(n):
            m, info = self.parts(j)
            if not m:
                continue
            h = mix64(s ^ mix64(np.array([j + 1], dtype=U64)))
            part = ((h >> U64(32)) * U64(m) >> U64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part = part[order]
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            value = np.bitwise_xor.reduceat(mix64(h[order] + U64(1)), first)
            size = np.diff(np.concatenate((first, [n])))
            at = part[first]
            rich = size >= info
            high = min(self.low[j + 1] - 1, n * self.den // self.num)
            need = self.most(n + high) + 1  # so many rich parts, the first ones, and one of them must match
            rich = np.flatnonzero(size >= info)
            if len(rich) >= need:
                at, value = at[rich[:need]], value[rich[:need]]
            else:  # too few parts that say much: send all, the empty ones too
                empty = np.setdiff1d(np.arange(m), at)
                at, value = np.concatenate((at, empty)), np.concatenate((value, np.zeros(len(empty), dtype=U64)))
            out.append(mix64(value + mix64(at.astype(U64) * U64(4096) + U64(j))))
        return np.concatenate(out) if out else np.zeros(0, dtype=U64)


# ---------------------------------------------------------------- tasks


def _classes(names: list[str], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, sketch = [], [], [], []
            for _, s in sets_of(batch.column(batch.num_columns - 1), k):
                x, y = set_key(s) if len(s) else (0, 0)
                n.append(len(s))
                a.append(x)
                b.append(y)
                sketch.append(small_sketch(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, type=pa.int64()), pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64()), pa.array(sketch, type=pa.binary())], names=[*names, "n", "a", "b", "sketch"])

    return tidied(run)


def _part_keys(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()

        def rows(keys: list, nodes: list, sizes: list) -> pa.RecordBatch:
            many = [len(x) for x in keys]
            return _pairs(("key", np.concatenate(keys).view(np.int64)), ("node", np.repeat(np.array(nodes, dtype=np.int64), many)), ("n", np.repeat(np.array(sizes, dtype=np.int32), many)))

        for batch in batches:
            keys, nodes, sizes, size = [], [], [], 0
            for _, s in sets_of(batch.column(0), k):
                if not len(s):
                    continue
                name = set_key(s)
                if name in seen:
                    continue
                seen.add(name)
                own = bands.keys(s)
                keys.append(own)
                nodes.append(name[0])
                sizes.append(len(s))
                size += len(own)
                if size > 200_000:
                    yield rows(keys, nodes, sizes)
                    keys, nodes, sizes, size = [], [], [], 0
            if keys:
                yield rows(keys, nodes, sizes)

    return tidied(run)


def _pairs(*columns: tuple[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for _, v in columns], names=[k for k, _ in columns])


def _stars(num: int, den: int):
    """From rows (key, node, n) sorted by key and node: each further node of a key with the key's first node, and whether their sizes allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_now, first, first_n, last = None, 0, 0, 0
        for batch in batches:
            key, node, n = (c.to_numpy() for c in batch.columns)
            if not len(key):
                continue
            new = np.concatenate(([key[0] != key_now], key[1:] != key[:-1]))
            starts = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            head = np.where(starts >= 0, node[np.maximum(starts, 0)], first)
            head_n = np.where(starts >= 0, n[np.maximum(starts, 0)], first_n)
            prev = np.concatenate(([last], node[:-1]))
            out = (node != head) & (new | (node != prev))
            total = n.astype(np.int64) + head_n
            fit = np.abs(n - head_n) <= total * (den - num) // (den + num)
            yield _pairs(("key", key[out]), ("a", head[out]), ("b", node[out]), ("fit", fit[out]))
            key_now, first, first_n, last = key[-1], head[-1], head_n[-1], node[-1]

    return tidied(run)


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, cls, blob = [], [], []
            for r, s in sets_of(batch.column(1), k):
                node.append(set_key(s)[0])
                cls.append(batch.column(0)[r].as_py())
                blob.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, type=pa.int64()), pa.array(cls, type=pa.int64()), pa.array(blob, type=pa.binary())], names=["node", "doc", "shingles"])

    return tidied(run)


def _close(num: int, den: int):
    """From rows (a, b, n_a, n_b, sketch of a, sketch of b): the pairs that the sketches allow, with their distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (batch.column(2).to_numpy() + batch.column(3).to_numpy()) * (den - num) // (den + num)
            far = np.zeros(batch.num_rows, dtype=np.int64)
            x, y = (c.cast(pa.large_binary()) for c in batch.columns[4:6])
            (raw_x, off_x), (raw_y, off_y) = _blob_view(x), _blob_view(y)
            size_x, size_y = np.diff(off_x), np.diff(off_y)
            for size in np.unique(size_x[size_x == size_y]):
                rows = np.flatnonzero((size_x == size) & (size_y == size))
                step = max(1, (1 << 21) // int(size))
                for i in range(0, len(rows), step):
                    some = rows[i : i + step]
                    at = np.arange(size)
                    far[some] = np.bitwise_count(raw_x[off_x[some][:, None] + at] ^ raw_y[off_y[some][:, None] + at]).sum(axis=1, dtype=np.int64)
            for r in np.flatnonzero(size_x != size_y):
                size = int(min(size_x[r], size_y[r]))
                far[r] = np.bitwise_count(folded(raw_x[off_x[r] : off_x[r + 1]].tobytes(), size) ^ folded(raw_y[off_y[r] : off_y[r + 1]].tobytes(), size)).sum()
            near = pa.array(far <= most)
            yield pa.RecordBatch.from_arrays([*(c.filter(near) for c in batch.columns[:2]), pa.array(far).filter(near)], names=["a", "b", "far"])

    return tidied(run)


def _blob_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8), off


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, dtype=bool)
            left, right = batch.column(2), batch.column(3)
            for r in range(batch.num_rows):
                good[r] = _similar(np.frombuffer(left[r].as_buffer(), dtype=U64), np.frombuffer(right[r].as_buffer(), dtype=U64), num, den)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:2]], names=["a", "b"])

    return tidied(run)


def _similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = np.concatenate((x, y))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return den * shared >= num * (len(x) + len(y) - shared)


def family_links(comp: list[int], sets_: list[np.ndarray], num: int, den: int, side: list[int] | None = None, block: int = 256) -> list[tuple[int, int]]:
    """Places of sets whose similarity joins components that nothing has joined before; with ``side`` only sets of unlike sides are compared."""
    order = sorted(range(len(sets_)), key=lambda i: len(sets_[i]))
    n = np.array([len(sets_[i]) for i in order])
    sides = None if side is None else np.array([side[i] for i in order])
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while (p := up.get(c, c)) != c:
            up[c] = up.get(p, p)
            c = p
        return c

    bits = 1 << max(9, min(16, int(16 * 2 * n[-1] * (den - num) // (den + num)).bit_length()))

    def unpacked(i: int) -> np.ndarray:
        part = [sets_[k] for k in order[i : i + block]]
        at = np.repeat(np.arange(len(part)), [len(p) for p in part]) * bits + (np.concatenate(part) & U64(bits - 1)).astype(np.int64)
        return (np.bincount(at, minlength=len(part) * bits) & 1).astype(np.float32).reshape(len(part), bits)

    found, comps = [], np.array([comp[i] for i in order])
    for i in range(0, len(order), block):
        left = unpacked(i)
        roots = np.array([root(c) for c in comps.tolist()])
        for j in range(i, len(order), block):
            if num * n[j] > den * n[min(i + block, len(order)) - 1]:
                break  # from here on all are too large for all of this block
            rl, rr = roots[i : i + block], roots[j : j + block]
            total = n[i : i + block][:, None] + n[j : j + block][None, :]
            ok = (rl[:, None] != rr[None, :]) & (n[i : i + block][:, None] * den >= num * n[j : j + block][None, :])
            if sides is not None:
                ok &= sides[i : i + block][:, None] != sides[j : j + block][None, :]
            if i == j:
                ok &= np.triu(np.ones_like(ok), 1)
            if not ok.any():
                continue
            right = left if i == j else unpacked(j)
            far = left.sum(axis=1)[:, None] + right.sum(axis=1)[None, :] - 2 * (left @ right.T)
            ok &= far <= total * (den - num) // (den + num)
            x, y = np.nonzero(ok)
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                a, b = root(int(comps[i + p])), root(int(comps[j + q]))
                if a != b and _similar(sets_[order[i + p]], sets_[order[j + q]], num, den):
                    up[max(a, b)] = min(a, b)
                    found.append((order[i + p], order[j + q]))
            if len(x):
                roots = np.array([root(c) for c in comps.tolist()])
    return found


def _families(num: int, den: int):
    """From rows (family, p, q, side, comp, shingles) sorted by family, p, q: links between components, of sets of unlike sides where p and q differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, side, comp, held = None, [], [], []

        def done() -> pa.RecordBatch:
            links = family_links(comp, held, num, den, side if now[1] != now[2] else None) if held else []
            return _pairs(("a", np.array([comp[x] for x, _ in links], dtype=np.int64)), ("b", np.array([comp[y] for _, y in links], dtype=np.int64)))

        for batch in batches:
            for f, p, q, which, c, s in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (f, p, q) != now:
                    yield done()
                    now, side, comp, held = (f, p, q), [], [], []
                side.append(which)
                comp.append(c)
                held.append(np.frombuffer(s, dtype=U64))
        yield done()

    return tidied(run)


def _near(num: int, den: int, block: int = 512):
    """From rows (key, p, q, side, node, comp, n, sketch) sorted by key, p, q: the pairs across components, one of each side (or both of one where p = q), that size and sketch allow."""

    def pairs_of(same: bool, side, node, comp, n, sketch):
        size = min(map(len, sketch))
        sketch = np.stack([folded(x, size) for x in sketch])
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        for i in range(0, len(left), block):
            for j in range(i if same else 0, len(right), block):
                p, q = left[i : i + block], right[j : j + block]
                allowed = (n[p][:, None] + n[q][None, :]) * (den - num) // (den + num)
                x, y = np.nonzero((comp[p][:, None] != comp[q][None, :]) & (np.abs(n[p][:, None] - n[q][None, :]) <= allowed))
                if same and i == j:
                    x, y = x[x < y], y[x < y]
                for k in range(0, len(x), 1 << 16):
                    u, v = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
                    near = np.bitwise_count(sketch[p[u]] ^ sketch[q[v]]).sum(axis=1, dtype=np.int64) <= allowed[u, v]
                    if near.any():
                        u, v = node[p[u[near]]], node[q[v[near]]]
                        yield _pairs(("a", np.minimum(u, v)), ("b", np.maximum(u, v)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            group = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns[:3]], axis=1)
            if not len(group):
                continue
            cols = [c.to_numpy() for c in batch.columns[3:7]]
            sketch = np.empty(len(group), dtype=object)
            sketch[:] = batch.column(7).to_pylist()
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1), len(group)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if held and tuple(group[i]) != now:
                    yield from pairs_of(now[1] == now[2], *(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
                now = tuple(group[i])
                held.append((*(c[i:j] for c in cols), sketch[i:j]))
        if held:
            yield from pairs_of(now[1] == now[2], *(np.concatenate(x) for x in zip(*held, strict=True)))

    return tidied(run)


# ---------------------------------------------------------------- the operator


def ngram_join(docs: DataFrame, key: str = "doc_id", text: str = "text", words_: int = 5, num: int = 80, den: int = 100, family_size: int = FAMILY, family_bytes: int = FAMILY_BYTES, family_block: int = FAMILY_BLOCK, part_block: int = PART_BLOCK) -> DataFrame:
    """Per row of ``docs``: key, n_shingles and component_id, where documents link at Jaccard >= num / den.

    ``key`` is an integer column. component_id is the smallest key that links
    reach, the own one included. See the module for method and defined cases.
    """
    if not 0 < num <= den:
        raise ValueError("the threshold must lie in (0, 1]")
    spark = docs.sparkSession
    store, n_parts = Store(spark, "parity"), parts(spark)
    docs = docs.select(F.col(key).cast("long").alias("row_key"), F.col(text).cast("string").alias("row_text"))

    rows = store.put("rows", docs.mapInArrow(_classes(["row_key"], words_), "row_key long, n long, a long, b long, sketch binary"))
    classes = rows.where("n > 0 and row_key is not null").groupBy("a", "b", "n").agg(F.min("row_key").alias("doc"), F.first("sketch").alias("sketch"))
    classes = store.put("classes", classes)

    sent = docs.where("row_key is not null").select("row_text").mapInArrow(_part_keys(words_, num, den), "key long, node long, n int")
    stars = store.put("stars", sent.repartition(n_parts, "key").sortWithinPartitions("key", "node").mapInArrow(_stars(num, den), "key long, a long, b long, fit boolean"))
    nodes = stars.select(F.col("a").alias("node")).union(stars.select(F.col("b").alias("node"))).distinct()
    wanted = classes.join(nodes, classes.a == nodes.node, "left_semi").select("doc")
    sets = docs.join(wanted, docs.row_key == wanted.doc, "left_semi").dropDuplicates(["row_key"]).mapInArrow(_set_rows(words_), "node long, doc long, shingles binary")
    sets = store.put("sets", sets)
    store.drop()  # the shuffles of keys and texts are no longer needed
    sizes = classes.select(F.col("a").alias("node"), "n", "sketch")

    def allowed(pairs: DataFrame) -> DataFrame:
        """The pairs that sketches allow, with their distance; this settles most pairs before sets move."""
        x, y = (sizes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in "ab")
        return pairs.join(y, "b").join(x, "a").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(_close(num, den), "a long, b long, far long")

    def verified(pairs: DataFrame) -> DataFrame:
        """Links between the components of the pairs that are similar."""
        left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(s)) for c, s in ("ax", "by"))
        return pairs.join(right, "b").join(left, "a").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"), "x", "y").mapInArrow(_verify(num, den), "a long, b long")

    def joined(comps: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """The components after more links between them."""
        if links.isEmpty():
            return comps
        later = connected_components(links, store, name).select(F.col("node").alias("comp"), "component")
        return store.put(f"{name}-comps", comps.join(later, "comp", "left").select("node", "doc", F.coalesce("component", "comp").alias("comp")))

    def ends(comps: DataFrame) -> list[DataFrame]:
        return [comps.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}")) for c in "ab"]

    def settled(close: DataFrame, comps: DataFrame, name: str) -> DataFrame:
        """The components after all pairs: of a set's pairs the nearest is verified first, the others where their ends are not one component by then."""
        heads, tails = ends(comps)
        near = close.join(heads, "a").join(tails, "b").where("comp_a <> comp_b")
        one = near.groupBy("b").agg(F.min(F.struct("far", "a", "comp_a", "comp_b")).alias("x")).select("b", "x.a", "x.comp_a", "x.comp_b")
        one = store.put(f"{name}-one", one)
        comps = joined(comps, store.put(f"{name}-links", verified(one)), f"{name}-cc")
        store.drop()
        heads, tails = ends(comps)
        over = close.join(one.select("a", "b"), ["a", "b"], "left_anti").join(heads, "a").join(tails, "b").where("comp_a <> comp_b")
        over = store.put(f"{name}-over", over.select("a", "b", "comp_a", "comp_b"))
        if not over.isEmpty():
            comps = joined(comps, store.put(f"{name}-late", verified(over)), f"{name}-cd")
            store.drop()
        store.drop(f"{name}-one", f"{name}-over", f"{name}-links", f"{name}-late")
        return comps

    close = store.put("close", allowed(stars.where("fit").select("a", "b").distinct()))
    store.drop()
    comps = settled(close, store.put("comps", sets.select("node", "doc", F.col("doc").alias("comp"))), "star")

    # parts whose sets, without the first, are not one component yet; every pair with a part's first set, and so a part of two sets, was settled above
    members = stars.join(ends(comps)[1], "b")
    open_keys = members.groupBy("key").agg(F.count("*").alias("many"), F.min("comp_b").alias("least"), F.max("comp_b").alias("most")).where("least <> most").select("key", "many")
    still = store.put("open", members.join(open_keys, "key").select("key", "many", "a", "b", F.col("comp_b").alias("comp")))
    if not still.isEmpty():
        family = connected_components(still.select("a", "b"), store, "family")
        placed = still.select(F.col("b").alias("node"), "comp").distinct().join(family, "node", "left").select("node", "comp", F.coalesce("component", "node").alias("family"))
        placed = store.put("placed", placed.join(sizes.select("node", "n"), "node"))
        def block_pairs(members: DataFrame, group: str, size: int) -> DataFrame:
            """Each member of a group of ``many`` in every pair of blocks that has its own block, with the side it takes there."""
            out = members.withColumn("blocks", F.ceil(F.col("many") / size).cast("int"))
            out = out.withColumn("mine", F.pmod(F.xxhash64("node", group), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            return out.select(group, F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "node", "comp")

        weight = placed.groupBy("family").agg(F.count("*").alias("many"), F.sum("n").alias("total"), F.countDistinct("comp").alias("comps")).where("comps > 1")
        weight = store.put("weight", weight.select("family", "many", ((F.col("many") > family_size) | (F.col("total") * 8 > family_bytes)).alias("large")))
        small = block_pairs(placed.join(weight.where("not large"), "family"), "family", family_block).join(sets, "node").select("family", "p", "q", "side", "comp", "shingles")
        links = small.repartition(2 * n_parts, "family", "p", "q").sortWithinPartitions("family", "p", "q").mapInArrow(_families(num, den), "a long, b long")
        now = joined(comps, store.put("links", links), "small")
        large = placed.join(weight.where("large"), "family").select("node")
        if not large.isEmpty():
            # part by part
            pairs = block_pairs(still.withColumnRenamed("b", "node").join(large, "node", "left_semi"), "key", part_block)
            pairs = pairs.join(sizes, "node").select("key", "p", "q", "side", "node", "comp", "n", "sketch")
            near = pairs.repartition(n_parts, "key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(_near(num, den), "a long, b long").distinct()
            now = settled(store.put("near", allowed(near)), now, "part")
        comps = now
    store.drop("stars", "sets", "close", "open", "placed", "weight", "links", "near")

    final = comps.select("doc", "comp").join(comps.groupBy("comp").agg(F.min("doc").alias("component")), "comp").select("doc", "component")
    by_class = classes.join(final, "doc", "left").select("a", "b", "n", F.coalesce("component", "doc").alias("component"))
    # the smallest key of a component is the smallest of its class keys, which are the smallest of their classes
    return rows.join(by_class, ["a", "b", "n"], "left").select(F.col("row_key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("row_key").isNotNull(), F.coalesce("component", "row_key")).alias("component_id"))


def brute_force(items: list[tuple[int, str | None]], k: int, num: int, den: int) -> dict[int, tuple[int, int]]:
    """The same by comparing all pairs, for tests."""
    import re

    def of(t):
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = {i: of(t) for i, t in items}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for p, i in enumerate(ids):
        for j in ids[p + 1 :]:
            x, y = sets[i], sets[j]
            if x and y and min(len(x), len(y)) * den >= num * max(len(x), len(y)):
                both = len(x & y)
                if den * both >= num * (len(x) + len(y) - both):
                    u, v = sorted((root(i), root(j)))
                    up[v] = u
    return {i: (len(sets[i]), root(i)) for i in ids}
