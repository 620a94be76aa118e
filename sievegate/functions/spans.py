"""Matches with byte offsets from built-in functions, and overlap joins of spans.

Spark has no function that gives match offsets. Marking matches and splitting
at the marks gives the pieces, whose running byte length gives the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MARK = "\x01"
#: Pieces whose offsets are summed at once. An array that grows is copied at each step, so long lists are summed in blocks, and the blocks' sums once more.
_BLOCK = 64
_SPANS = "array<struct<start:bigint,end:bigint,text:string>>"


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though it stands in lambdas."""
    return F.transform(F.array(value), body)[0]


def offsets(pieces: Column, gap: int) -> Column:
    """(start, end, text) of the pieces, which stand ``gap`` bytes apart."""

    def within(part: Column, base: Column) -> Column:
        step = lambda a, x: F.struct((a.at + F.octet_length(x) + gap).alias("at"), F.concat(a.out, F.array(F.struct(a.at.alias("start"), (a.at + F.octet_length(x)).alias("end"), x.alias("text")))).alias("out"))
        return F.aggregate(part, F.struct(base.alias("at"), F.array().cast(_SPANS).alias("out")), step)["out"]

    def summed(blocks: Column) -> Column:
        add = lambda a, x: F.struct((a.at + x).alias("at"), F.concat(a.out, F.array(a.at)).alias("out"))
        sums = F.transform(blocks, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + gap))
        return F.aggregate(sums, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")), add)["out"]

    in_blocks = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _BLOCK).cast("int")), lambda i: F.slice(p, i * _BLOCK + 1, F.lit(_BLOCK)))
    whole = lambda blocks: F.flatten(F.zip_with(blocks, summed(blocks), within))
    return bound(pieces, lambda p: bound(in_blocks(p), whole))


def regex_hits(text: Column, pattern: str) -> Column:
    """Array of (start, end, text) of the matches of a Java pattern, in bytes; empty where none or null."""
    clean = F.replace(text, F.lit(_MARK), F.lit("\x02"))  # one byte for one byte
    pieces = F.split(F.regexp_replace(clean, F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK)
    hits = F.filter(offsets(pieces, 0), lambda x, i: i % 2 == 1)
    return F.when(text.rlike(pattern), hits).otherwise(F.array().cast(_SPANS))


def literal_starts(text: Column, needle: str) -> Column:
    """Byte starts of the non-overlapping occurrences of a literal."""
    pieces = F.split(text, "\\Q" + needle + "\\E")
    ends = lambda spans: F.transform(F.slice(spans, 1, F.size(spans) - 1), lambda x: x.end)
    return F.when(F.contains(text, F.lit(needle)), bound(offsets(pieces, len(needle.encode())), ends)).otherwise(F.array().cast("array<bigint>"))


def overlap_join(left: DataFrame, right: DataFrame, key: str, page: int = 1024) -> DataFrame:
    """Pairs of spans (columns start, end) of one key that overlap, as l_* and r_* columns beside the key.

    Spans are dealt to pages of ``page`` bytes, so that a long text with many
    spans is no single group; a pair is kept in its first common page only.
    """
    pages = lambda c: F.explode(F.sequence(F.floor(F.col(f"{c}_start") / page), F.floor(F.greatest(F.col(f"{c}_end") - 1, F.col(f"{c}_start")) / page)))
    sides = []
    for df, c in ((left, "l"), (right, "r")):
        renamed = df.select(F.col(key), *[F.col(x).alias(f"{c}_{x}") for x in df.columns if x != key])
        sides.append(renamed.withColumn("page", pages(c)))
    both = sides[0].join(sides[1], [key, "page"])
    first = F.greatest(F.floor(F.col("l_start") / page), F.floor(F.col("r_start") / page))
    return both.where((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & (F.col("page") == first)).drop("page")
