"""Artifacts to channels, a row an artifact: adapters by kind, pinned outside tools as ports, and what a page shows against what it says.

Decoding of pictures and films, speech and full PDF need libraries or tools that
are not part of the engine. They are ports: a callable from bytes to text, with
a name and a digest that pin it. Adapters only report; they know no verdicts.
"""

from __future__ import annotations

import hashlib
import json
import re
import subprocess
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from struct import error as struct_error

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import audio, code, media

Channel = tuple[str, str, str, float | None, bool]  # kind, content, extractor, confidence, truncated


@dataclass(frozen=True)
class Port:
    """An outside tool: ``kind`` of channel that it gives, its name and the digest it is pinned to."""

    kind: str
    name: str
    digest: str
    read: Callable[[bytes], str]


def pinned_tool(kind: str, path: str, sha384: str, arguments: tuple[str, ...] = ()) -> Port:
    """A program as a port. The bytes go to its input, never to its arguments; another digest, a failure or output that is no UTF-8 is an error."""

    def read(raw: bytes) -> str:
        with open(path, "rb") as f:
            if hashlib.sha384(f.read()).hexdigest() != sha384:
                raise ValueError("the tool is not the pinned one")
        done = subprocess.run([path, *arguments], input=raw, capture_output=True, check=False)
        if done.returncode:
            raise ValueError(f"the tool ended with {done.returncode}")
        return done.stdout.decode("utf-8")

    return Port(kind, path.rsplit("/", 1)[-1], sha384, read)


def _facts(facts: dict) -> str:
    return "".join(f"{k} = {v}\n" for k, v in facts.items())


def _image(raw: bytes) -> tuple[dict, list[Channel]]:
    facts = media.image_facts(raw)
    return facts, [("metadata", _facts(facts), "image-header", None, False)]


def _audio(raw: bytes) -> tuple[dict, list[Channel]]:
    w = audio.read_wav(raw)
    facts = {"sample_rate": w.rate, "channels": w.channels, "bits_per_sample": w.bits, "sample_format": w.form, "duration_secs": f"{w.seconds:.3f}"}
    report = audio.spectrum(audio.mono(w.samples, w.channels), w.rate, digest=hashlib.sha384(raw).hexdigest())
    more = [("metadata", json.dumps(report), "spectral", None, w.dropped > 0)] if report else []
    return facts | ({"dropped_samples": w.dropped} if w.dropped else {}), [("metadata", _facts(facts), "wav-header", None, False), *more]


def _video(raw: bytes) -> tuple[dict, list[Channel]]:
    facts = media.film_facts(raw)
    counts = {k: v for k, v in facts.items() if k != "videos"}
    sizes = {f"video{i}.{k}": v for i, t in enumerate(facts["videos"]) for k, v in t.items() if k != "kind"}
    return counts | sizes, [("metadata", _facts(counts), "film-header", None, False)]


def _document(raw: bytes) -> tuple[dict, list[Channel]]:
    if raw.startswith(b"%PDF"):
        text = media.pdf_strings(raw)
        facts = {"format": "pdf", "char_count": len(text), "truncated": True}
        if text:
            return facts, [("text_layer", text, "pdf-strings", 0.6, True)]
        return facts, [("metadata", "pdf_text_extracted = 0\npdf_truncated = true\n", "pdf-header", None, True)]
    if not media.likely_text(raw):
        raise ValueError("unsupported media type")
    text = raw.decode("utf-8", "replace")
    return {"format": "plain_text", "char_count": len(text), "line_count": len(text.splitlines())}, [("text_layer", text, "text", 1.0, False)]


def _code(raw: bytes) -> tuple[dict, list[Channel]]:
    s = code.split_code(raw.decode("utf-8", "replace"))
    facts = {"code_lines": s.code_lines, "comment_lines": s.comment_lines, "string_literals": s.string_literals}
    channels = [("structure", _facts(facts), "code-facts", None, False)]
    return facts, channels + [("text_layer", t, n, 1.0, False) for t, n in ((s.comments, "comments"), (s.strings, "strings")) if t]


ADAPTERS = {"image": _image, "audio": _audio, "video": _video, "document": _document, "text": _document, "code": _code}
_CHANNEL = pa.struct([("kind", pa.string()), ("content", pa.string()), ("extractor", pa.string()), ("confidence", pa.float64()), ("truncated", pa.bool_())])
SCHEMA = "source_id string, modality string, artifact_digest string, properties map<string,string>, channels array<struct<kind:string,content:string,extractor:string,confidence:double,truncated:boolean>>, error string"


def perceive(artifacts: DataFrame, ports: dict[str, list[Port]] | None = None, source: str = "path", content: str = "content", modality: str = "modality") -> DataFrame:
    """``SCHEMA`` for each artifact; what cannot be read is an error of its row. ``ports`` add channels by modality, those of a failing tool become its row's error."""
    ports = ports or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, raw, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = raw or b""
                row = {"source_id": name, "modality": kind, "artifact_digest": hashlib.sha384(raw).hexdigest(), "properties": [], "channels": [], "error": None}
                try:
                    if kind not in ADAPTERS:
                        raise ValueError("unsupported media type")
                    facts, channels = ADAPTERS[kind](raw)
                    channels += [(p.kind, p.read(raw), f"{p.name}@{p.digest}", None, False) for p in ports.get(kind, [])]
                    row["properties"] = [(k, str(v)) for k, v in facts.items()]
                    row["channels"] = [dict(zip(_CHANNEL.names, c, strict=True)) for c in channels]
                except (ValueError, struct_error, OSError) as e:
                    row["error"] = str(e)
                rows.append(row)
            kinds = {"source_id": pa.string(), "modality": pa.string(), "artifact_digest": pa.string(), "properties": pa.map_(pa.string(), pa.string()), "channels": pa.list_(_CHANNEL), "error": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in kinds.items()], names=list(kinds))

    return artifacts.select(F.col(source).cast("string"), F.col(content).cast("binary"), F.col(modality).cast("string")).mapInArrow(run, SCHEMA)




def channel_rows(perceived: DataFrame) -> DataFrame:
    """(source_id, modality, kind, content), a row a channel, as the fusion audit takes them."""
    return perceived.select("source_id", "modality", F.explode("channels").alias("c")).select("source_id", "modality", "c.kind", "c.content")


_WORD = re.compile("[^ \\t\\n\\x0b\\f\\r]+")
_EDGE = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
_LINE = re.compile("\\r?\\n")


class _Words:
    """The distinct words of texts in lower case, without marks at their ends; what is trimmed is kept for a while, as words come again."""

    def __init__(self) -> None:
        self.kept: dict[str, str] = {}

    def __call__(self, low: str) -> set[str]:
        kept, out = self.kept, set()
        for w in set(_WORD.findall(low)):
            if w[0].isalnum() and w[-1].isalnum():
                out.add(w)
                continue
            t = kept.get(w)
            if t is None:
                if len(kept) > 200_000:
                    kept.clear()
                t = kept[w] = _EDGE.sub("", w)
            out.add(t)
        out.discard("")
        return out


def divergent_lines(extracted: Column, rendered: Column, least: float = 0.8) -> Column:
    """Lines of the extracted text less than ``least`` of whose words are on the rendered page; words are compared as sets, in lower case and without marks at their ends. The page's words are cut once a text."""

    def run(extracted: pa.Array, low: pa.Array, rendered: pa.Array) -> pa.Array:
        words, out = _Words(), []
        for e, x, r in zip(extracted, low, rendered, strict=True):
            text, page = e.as_py(), r.as_py()
            if text is None or page is None:
                out.append(None if text is None else [])
                continue
            shown, found = words(page), []
            for line, small in zip(_LINE.split(text), _LINE.split(x.as_py()), strict=True):
                own = words(small)
                if own and len(own & shown) < least * len(own):
                    found.append(line)
            out.append(found)
        return pa.array(out, type=pa.list_(pa.string()))

    run.__annotations__ = {"extracted": pa.Array, "low": pa.Array, "rendered": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<string>")(extracted, F.lower(extracted), F.lower(rendered))
