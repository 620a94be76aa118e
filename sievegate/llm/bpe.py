"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a batch lie in one array. A map leads from each pair of
neighbouring symbols to all of its positions; the active ranks are applied in
ascending order, each at all its positions at once, and the lists of the pairs
that a merge makes or breaks are brought up to date. Words met before are kept
in a bounded cache of the task.

The vocabulary file (of the tokenizers library, with end-of-word suffix) is
read by the driver and sent to the tasks; its size is fixed by its format. Text
is split at the added tokens, brought to NFC, white space runs to one space,
lower case by character, split by the file's pattern, and bytes are spelled in
the byte alphabet of byte-level BPE.

Defined cases: a null text is empty and has no tokens; an unknown id fails.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches
from .texts import tidied

#: Words of a task's cache; a full cache is emptied.
CACHE = 300_000


def byte_alphabet() -> list[str]:
    """Printable Latin-1 bytes stand for themselves, the others for characters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _columns(ranks: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array(list(ranks), dtype=np.int64), np.array(list(ranks.values()), dtype=np.int64)


class PairIndexBPE:
    """The model of one vocabulary file."""

    def __init__(self, spec: str) -> None:
        file = json.loads(spec)
        model = file["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.made: list[tuple[int, int, int]] = []  # by rank: the pair and what it becomes
        after: dict[int, dict[int, int]] = defaultdict(dict)
        before: dict[int, dict[int, int]] = defaultdict(dict)
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y = self.vocab[a], self.vocab[b]
            self.made.append((x, y, self.vocab[a + b]))
            before[y].setdefault(x, after[x].setdefault(y, r))
        # of a symbol: the symbols that may stand after (before) it in a pair, and the ranks of the pairs
        self.after = {x: _columns(y) for x, y in after.items()}
        self.before = {x: _columns(y) for x, y in before.items()}
        self.hits = np.full(max(self.vocab.values(), default=0) + 1, -1, dtype=np.int64)  # scratch, by symbol
        split = [p for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern = regex.compile(split[0]["pattern"]["Regex"].replace(r"\s", _SPACE_IN_CLASS))
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.mark = os.path.commonprefix(list(self.added))  # what every added token begins with
        alphabet = byte_alphabet()
        # bytes inside a word, then last bytes; -1 where the vocabulary has none
        self.spelled = np.array([self.vocab.get(c, -1) for c in alphabet] + [self.vocab.get(c + self.suffix, -1) for c in alphabet], dtype=np.int64)
        spells = self.spelled.tolist()
        self.first = np.array([[after.get(y, -1) for y in spells] for after in (after.get(x, {}) for x in spells)], dtype=np.int64)
        self.ids_of: dict[str, bytes] = {}
        self.text_of: dict[str, str] = {}

    # -- words

    def ranks(self, pairs: tuple[np.ndarray, np.ndarray], symbols: np.ndarray) -> np.ndarray:
        """The rank of the pair with each of ``symbols``, -1 if there is none; ``pairs`` are an entry of ``after`` or ``before``."""
        self.hits[pairs[0]] = pairs[1]
        found = self.hits[symbols]
        self.hits[pairs[0]] = -1
        return found

    def merge_words(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Ids of all words, merged at once, one word after the other, and where each word begins (and the last ends)."""
        raw = [w.encode() for w in words]
        stop = np.cumsum([len(w) for w in raw], dtype=np.int64)
        kind = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
        kind[stop - 1] += 256
        known = self.spelled[kind] >= 0
        kind = kind[known]
        n = len(kind)
        start = np.concatenate(([0], np.cumsum(known)))[np.concatenate(([0], stop))]
        if not n:
            return [], start.tolist()
        ends = np.arange(1, n + 1)
        ends[start[1:] - 1] = -1
        begins = np.arange(-1, n - 1)
        begins[start[:-1][start[:-1] < n]] = -1
        pairs = np.where(ends[:-1] >= 0, self.first[kind[:-1], kind[1:]], -1)
        symbol, right, left = self.spelled[kind], ends, begins
        where: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def index(ranks: np.ndarray, places: np.ndarray) -> None:
            some = np.flatnonzero(ranks >= 0)
            if not len(some):
                return
            some = some[np.argsort(ranks[some], kind="stable")]
            ranks, places = ranks[some], places[some]
            cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cut.tolist(), len(ranks)]
            for r, i, j in zip(ranks[bounds[:-1]].tolist(), bounds[:-1], bounds[1:], strict=True):
                if r in where:
                    where[r].append(places[i:j])
                else:
                    where[r] = [places[i:j]]
                    heapq.heappush(active, r)

        index(pairs, np.arange(n - 1))
        while active:
            r = heapq.heappop(active)
            found = where.pop(r)
            a, b, new = self.made[r]
            at = np.unique(np.concatenate(found)) if len(found) > 1 or a == b else found[0]
            to = right[at]
            at = at[(to >= 0) & (symbol[at] == a) & (symbol[to] == b)]  # of others another merge has taken one symbol
            if a == b and len(at) > 1:  # places may overlap: every second one of a run, from the left
                fresh = np.concatenate(([True], right[at[:-1]] != at[1:]))
                run = np.arange(len(at))
                at = at[(run - np.maximum.accumulate(np.where(fresh, run, 0))) % 2 == 0]
            if not len(at):
                continue
            to = right[at]
            beyond = right[to]
            symbol[at], symbol[to] = new, -1
            right[at] = beyond
            inner = beyond >= 0
            left[beyond[inner]] = at[inner]
            if new in self.after:
                index(self.ranks(self.after[new], symbol[beyond[inner]]), at[inner])
            if new in self.before:
                behind = left[at]
                behind = behind[behind >= 0]
                index(self.ranks(self.before[new], symbol[behind]), behind)
        alive = symbol >= 0
        return symbol[alive].tolist(), np.concatenate(([0], np.cumsum(alive)))[start].tolist()

    def learn(self, fresh: list[str]) -> None:
        """Take words that are not in the caches into them."""
        if not fresh:
            return
        ids, start = self.merge_words(fresh)
        raw = np.array(ids, dtype="<u4").tobytes()
        names = [self.token[i] for i in ids]
        for w, i, j in zip(fresh, start[:-1], start[1:], strict=True):
            self.ids_of[w] = raw[4 * i : 4 * j]
            self.text_of[w] = names[i] if j == i + 1 else " ".join(names[i:j])

    # -- texts

    def pieces(self, text: str) -> list[str]:
        """Words and added tokens of a text; added tokens are their own words in the caches."""
        if self.special is None or self.mark not in text:
            return self.pattern.findall(normal(text))
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.pattern.findall(normal(text[at : m.start()]))
            out.append("\0" + m.group())
            at = m.end()
        return out + self.pattern.findall(normal(text[at:]))

    def prepare(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text, all of which are in the caches afterwards."""
        if len(self.ids_of) > CACHE:
            self.ids_of.clear()
            self.text_of.clear()
        for token, i in self.added.items():
            self.ids_of["\0" + token] = np.array([i], dtype="<u4").tobytes()
            self.text_of["\0" + token] = token
        all_ = [self.pieces(t) for t in texts]
        self.learn([w for w in set().union(*all_) if w not in self.ids_of])
        return all_

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(b"".join([self.ids_of[w] for w in p]), dtype="<u4").tolist() for p in self.prepare(texts)]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join([self.token[i] for i in ids])


#: White space as Unicode has it (property White_Space).
_SPACE_IN_CLASS = r"\t-\r\x20\x85\xA0  -     　"


def normal(text: str) -> str:
    """A text for the pattern, which passes over white space, however much."""
    if text.isascii():
        return text.lower()
    # each character by itself: a final sigma is no special case
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _slices(column: pa.Array, limit: int = 2 << 20) -> Iterator[list[str]]:
    texts, size = [], 0
    for t in column:
        t = t.as_py() or ""
        texts.append(t)
        size += len(t)
        if size >= limit:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def _encode(shared, names: list[str], digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PairIndexBPE(shared.value)
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(batch.num_columns - 1)):
                rest = [c.slice(at, len(texts)) for c in batch.columns[:-1]]
                at += len(texts)
                n, ids_, hashes, decoded = [], [], [], []
                for words in model.prepare(texts):
                    ids = b"".join(map(model.ids_of.__getitem__, words))
                    n.append(len(ids) // 4)
                    if digests:
                        hashes.append(hashlib.sha256(ids).hexdigest())
                        decoded.append(hashlib.sha256(" ".join(filter(None, map(model.text_of.__getitem__, words))).encode()).hexdigest())
                    else:
                        ids_.append(np.frombuffer(ids, dtype="<u4").astype(np.int32))
                more = [pa.array(n, type=pa.int64()), *([pa.array(hashes), pa.array(decoded)] if digests else [pa.array(ids_, type=pa.list_(pa.int32()))])]
                yield pa.RecordBatch.from_arrays([*rest, *more], names=[*names, "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids"])])

    return tidied(run)


def _decode(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PairIndexBPE(shared.value)
        for batch in batches:
            texts = [model.decode(x) if x is not None else None for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, type=pa.string())], names=[*names, "decoded"])

    return tidied(run)


def _schema(df: DataFrame, key: str, more: str) -> str:
    return f"`{key}` {df.schema[key].dataType.simpleString()}, {more}"


def _spec(df: DataFrame, path: str):
    bounded_batches(df.sparkSession)
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def bpe_encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens and ids (array of int)."""
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(_encode(_spec(docs, path), [key], False), _schema(docs, key, "n_tokens long, ids array<int>"))


def bpe_decode(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: key and decoded, the tokens joined by spaces as the file asks for no decoder; null ids give null."""
    return rows.select(F.col(key), F.col(ids).alias("_ids")).mapInArrow(_decode(_spec(rows, path), [key]), _schema(rows, key, "decoded string"))


def bpe_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens and the SHA-256 of the ids (unsigned 32-bit, little-endian) and of the decoded text."""
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(_encode(_spec(docs, path), [key], True), _schema(docs, key, "n_tokens long, ids_sha256 string, decoded_sha256 string"))
