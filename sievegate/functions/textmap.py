"""Canonical text and the way back to raw bytes.

Clusters are cut from the raw text and brought to a normal form one by one. A
range of the canonical text maps to the union of the raw ranges of all clusters
it touches, so ranges widen to whole clusters. Offsets are UTF-8 bytes.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

import numpy as np
import regex

#: Characters without a glyph of their own.
INVISIBLE_CLASS = "­᠎​-‍⁠⁡-⁤﻿‪-‮⁦-⁩￹-￻\U000e0000-\U000e007f"
_CLUSTER = regex.compile(r"\X")
_HIDDEN = regex.compile(f"[{INVISIBLE_CLASS}]+")
#: Characters that may join with a neighbour; all others (Latin, Greek, Cyrillic, CJK, punctuation and the like) are clusters of their own.
_JOINING = re.compile("[^\0-\u02ff\u0370-\u0482\u048a-\u0590\u1e00-\u200b\u200e-\u20cf\u2100-\u2cee\u3000-\u3029\u3030-\u3098\u309b-\ua66e\uff00-\uff9d]")


def single(text: str) -> bool:
    """Whether each character is surely a cluster of its own."""
    return "\r\n" not in text and (text.isascii() or not _JOINING.search(text))


def clusters(text: str) -> list[str]:
    return list(text) if single(text) else _CLUSTER.findall(text)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def byte_offsets(chars: np.ndarray) -> np.ndarray:
    """The UTF-8 bytes before each character, and before the end."""
    size = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
    return np.concatenate(([0], np.cumsum(size)))


def is_hidden(cluster: str) -> bool:
    """Whether a cluster has invisible characters only."""
    return _HIDDEN.fullmatch(cluster) is not None


class TextMap:
    """The canonical text of a raw text, and raw ranges of its parts."""

    def __init__(self, raw: str, form: str = "nfc", strip: bool = False, base: int = 0) -> None:
        self.raw, self.base, self.strip = raw, base, strip
        self.form = None if form == "none" else form.upper()
        plain = raw.isascii() or (self.form is None or unicodedata.is_normalized(self.form, raw))
        self._units: tuple[list[int], list[tuple[int, int]]] | None = None
        if plain and not (strip and _HIDDEN.search(raw)):
            self.text = raw  # clusters of a normal text are normal
        else:
            self.text = "".join(t for t, _, _ in self._walk())
        self._same: bool | None = None
        self._bytes: bytes | None = None

    def _walk(self):
        """(canonical, raw start, raw end) of each cluster that stays."""
        at = self.base
        for g in clusters(self.raw):
            end = at + len(g.encode())
            if not (self.strip and is_hidden(g)):
                yield (unicodedata.normalize(self.form, g) if self.form else g), at, end
            at = end

    def encoded(self) -> bytes:
        if self._bytes is None:
            self._bytes = self.raw.encode()
        return self._bytes

    def raw_bytes(self, start: int, end: int) -> bytes:
        """The bytes of a raw range."""
        return self.encoded()[start - self.base : end - self.base]

    def units(self) -> tuple[list[int], list[tuple[int, int]]]:
        """Starts of the clusters in the canonical text, with its size as the last one, and their raw ranges."""
        if self._units is None and self.text is self.raw:
            ends = np.cumsum(np.fromiter(map(len, clusters(self.raw)), dtype=np.int64))
            starts = byte_offsets(code_points(self.raw))[np.concatenate(([0], ends))]
            low = (starts + self.base).tolist()
            self._units = (starts.tolist(), list(zip(low, low[1:], strict=False)))
        if self._units is None:
            starts, ranges, at = [], [], 0
            for t, a, b in self._walk():
                starts.append(at)
                ranges.append((a, b))
                at += len(t.encode())
            self._units = ([*starts, at], ranges)
        return self._units

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The raw range of a range of the canonical text; (0, 0) if it touches no cluster."""
        if self._same is None:
            self._same = self.text is self.raw and single(self.raw)
        if self._same:
            raw = self.encoded()
            n = len(raw)
            start, end = max(start, 0), min(end, n)
            if start >= end:
                return 0, 0
            while raw[start] & 0xC0 == 0x80:  # ranges widen to whole characters
                start -= 1
            while end < n and raw[end] & 0xC0 == 0x80:
                end += 1
            return start + self.base, end + self.base
        starts, ranges = self.units()
        first, last = bisect_right(starts, start) - 1, bisect_left(starts, end) - 1
        first, last = max(first, 0), min(last, len(ranges) - 1)
        if start >= end or last < first or start >= starts[-1]:
            return 0, 0
        return ranges[first][0], ranges[last][1]
