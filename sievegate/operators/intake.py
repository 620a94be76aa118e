"""Intake: size and UTF-8 gates, grapheme clusters with byte ranges, normal forms, and taint."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.severity import default_trust
from ..functions.spans import bound, offsets
from .detectors import INVISIBLE


def size_status(text: Column, most: int = 1 << 20) -> Column:
    return F.when(F.octet_length(text) > most, "input_too_large").otherwise("ok")


def utf8(raw: Column, mode: str = "monitor") -> tuple[Column, Column]:
    """(text, status) of bytes: invalid UTF-8 is read with replacement characters in monitor mode, else it is an error."""
    ok = F.is_valid_utf8(raw.cast("string"))
    fixed = F.make_valid_utf8(raw.cast("string"))
    if mode == "monitor":
        return fixed, F.when(ok, "ok").otherwise("repaired")
    return F.when(ok, fixed), F.when(ok, "ok").otherwise("invalid_utf8")


def graphemes(text: Column) -> Column:
    """Extended grapheme clusters of the raw text."""
    return F.regexp_extract_all(text, F.lit("\\X"), F.lit(0))


def cluster_count(text: Column) -> Column:
    """Number of clusters of a text. Characters of ASCII are clusters, but for the end of a line in two of them."""
    plain = (F.octet_length(text) == F.char_length(text)) & ~F.contains(text, F.lit("\r\n"))
    return F.when(plain, F.char_length(text)).otherwise(F.regexp_count(text, F.lit("\\X"))).cast("long")


def _form(form: str):
    def run(texts: pa.Array) -> pa.Array:
        # Arrow's own kernel does not compose; texts that are normal already, as all ASCII is, pass as they are
        same = lambda t: t is None or t.isascii() or unicodedata.is_normalized(form, t)
        values = texts.to_pylist()
        if all(map(same, values)):
            return texts
        return pa.array([t if same(t) else unicodedata.normalize(form, t) for t in values], type=pa.string())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")


def normalize(text: Column, form: str = "nfc") -> Column:
    """Normal form, in Arrow batches."""
    return text if form == "none" else _form(form.upper())(text)


def strip_all(text: Column) -> Column:
    return F.regexp_replace(text, f"[{INVISIBLE}]", "")


def strip_clusters(clusters: Column) -> Column:
    """Clusters of invisible characters alone go; invisible characters attached to a visible one stay."""
    return F.filter(clusters, lambda g: ~g.rlike(f"^[{INVISIBLE}]+$"))


def canonical(text: Column, form: str = "nfc", strip: bool = False) -> Column:
    clusters = graphemes(text)
    return normalize(F.array_join(strip_clusters(clusters) if strip else clusters, ""), form)


def ranges(clusters: Column, base: Column | int = 0) -> Column:
    """Array of (text, start, end): clusters with their byte ranges in the raw text."""
    b = F.lit(base).cast("long") if isinstance(base, int) else base
    return F.transform(offsets(clusters, 0), lambda g: F.struct(g.text.alias("text"), (g.start + b).alias("start"), (g.end + b).alias("end")))


def range_ends(text: Column) -> Column:
    """(clusters, first_end, last_end) of the ``ranges`` of a text's clusters, without a list of them; ends are 0 where there is no cluster. Clusters cover the whole text."""
    plain = (F.octet_length(text) == F.char_length(text)) & ~F.startswith(text, F.lit("\r\n"))
    first = F.when(plain, F.least(F.octet_length(text), F.lit(1))).otherwise(F.coalesce(F.octet_length(F.regexp_substr(text, F.lit("\\X"))), F.lit(0)))
    return F.struct(cluster_count(text).alias("clusters"), first.cast("long").alias("first_end"), F.octet_length(text).cast("long").alias("last_end"))


def tainted(text: Column, provenance: Column) -> Column:
    """Clusters with provenance, trust rank and boundary context (start, interior, end; a single one is start)."""
    context = lambda i, n: F.when(i == 0, "start").when(i == n - 1, "end").otherwise("interior")
    one = lambda g, i, n: F.struct(g.alias("text"), provenance.alias("provenance"), default_trust(provenance).alias("trust"), context(i, n).alias("context"))
    return bound(graphemes(text), lambda c: F.transform(c, lambda g, i: one(g, i, F.size(c))))


def tainted_counts(text: Column, provenance: Column) -> Column:
    """Array of (context, trust, clusters): how many clusters of ``tainted`` are in each context, without a list of them."""

    def counted(n: Column) -> Column:
        each = (("start", F.least(n, F.lit(1))), ("end", F.least(n - 1, F.lit(1))), ("interior", n - 2))
        return F.filter(F.array(*[F.struct(F.lit(c).alias("context"), default_trust(provenance).alias("trust"), k.cast("long").alias("clusters")) for c, k in each]), lambda x: x.clusters > 0)

    return bound(F.coalesce(cluster_count(text), F.lit(0).cast("long")), counted)
