"""Facts in the headers of images, films and documents."""

from __future__ import annotations

import re
import struct

#: Boxes of a film that hold other boxes.
_HOLDERS = {b"moov", b"trak", b"mdia"}


def image_facts(raw: bytes) -> dict[str, int | str]:
    """Format, width and height of PNG, GIF and JPEG."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        w, h = struct.unpack_from(">II", raw, 16)
        return {"format": "png", "width": w, "height": h}
    if raw[:6] in (b"GIF87a", b"GIF89a") and len(raw) >= 10:
        w, h = struct.unpack_from("<HH", raw, 6)
        return {"format": "gif", "width": w, "height": h}
    at = 2
    while raw[:2] == b"\xff\xd8" and at + 9 < len(raw) and raw[at] == 0xFF:
        kind, size = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", raw, at + 5)
            return {"format": "jpeg", "width": w, "height": h}
        at += 2 + size
    raise ValueError("no image that is known")


def _boxes(raw: bytes, at: int, end: int):
    while at + 8 <= end:
        size, name = struct.unpack_from(">I4s", raw, at)
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", raw, at + 8)[0], 16
        size = end - at if size == 0 else size
        if size < head or at + size > end:
            return
        yield name, at + head, at + size
        at += size


def film_facts(raw: bytes) -> dict:
    """Tracks of an MP4 by kind, with size and duration of the pictures."""
    tracks: list[dict] = []

    def walk(at: int, end: int) -> None:
        for name, a, b in _boxes(raw, at, end):
            if name == b"trak":
                tracks.append({})
            if name in _HOLDERS:
                walk(a, b)
            elif name == b"tkhd" and tracks and b - a >= 84:
                w, h = struct.unpack_from(">II", raw, b - 8)
                tracks[-1] |= {"width": w >> 16, "height": h >> 16}
            elif name == b"mdhd" and tracks and b - a >= 20:
                scale, length = struct.unpack_from(">IQ", raw, a + 20) if raw[a] else struct.unpack_from(">II", raw, a + 12)
                tracks[-1]["seconds"] = round(length / scale, 3) if scale else 0.0
            elif name == b"hdlr" and tracks and b - a >= 12:
                tracks[-1]["kind"] = {b"vide": "video", b"soun": "audio"}.get(raw[a + 8 : a + 12], "subtitle")

    if raw[4:8] != b"ftyp":
        raise ValueError("no film that is known")
    walk(0, len(raw))
    many = lambda k: sum(t.get("kind") == k for t in tracks)
    return {"video_tracks": many("video"), "audio_tracks": many("audio"), "subtitle_tracks": many("subtitle"), "videos": [t for t in tracks if t.get("kind") == "video"]}


def likely_text(raw: bytes) -> bool:
    """More than 85 % of the bytes print."""
    good = sum(33 <= b < 127 or b in b" \n\r\t" for b in raw)
    return bool(raw) and good / len(raw) > 0.85


_LITERAL = re.compile(r"\(((?:\\.|[^)\\])*)\)", re.DOTALL)


def pdf_strings(raw: bytes) -> str:
    """The string literals of a PDF that cannot be read otherwise: a guess at its text, of printable ASCII."""
    text = "".join(re.sub(r"\\(.)", r"\1", m[1], flags=re.DOTALL) + " " for m in _LITERAL.finditer(raw.decode("utf-8", "replace")) if m[1])
    return "".join(c for c in text if " " <= c <= "~" or c == "\n")
