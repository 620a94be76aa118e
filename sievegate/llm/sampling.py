"""Bounded samples of whole texts for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANGE = 1 << 40
#: Groups of a sample, the most frequent first.
MOST_GROUPS = 1000
#: Bytes of a sample in all; a group has an equal share.
MOST_BYTES = 16 << 20


def _threshold(counts: dict, column: str, want: int) -> Column:
    """Per group the bound on hashes modulo ``_RANGE`` under which somewhat more than ``want`` of its members lie."""
    return F.element_at(F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, int(_RANGE * min(1.0, 1.2 * (want + 20) / n)))]), F.col(column))


def _in_hash_order(rows: DataFrame, groups: list, want: int, most_bytes: int) -> dict:
    """From rows (g, t): per group up to ``want`` distinct whole texts, in the order of their hashes.

    A group's texts end where its share of ``most_bytes`` does; texts larger
    than a sixteenth of that share are not taken, so that one of them does not
    end the sample.
    """
    share = most_bytes // max(1, len(groups))
    fits = rows.where(F.col("t").isNotNull() & (F.octet_length("t") <= share // 16))
    once = fits.groupBy("g", F.xxhash64("t").alias("h")).agg(F.first("t").alias("t"))
    by = Window.partitionBy("g").orderBy("h")
    once = once.withColumns({"i": F.row_number().over(by), "sum": F.sum(F.octet_length("t")).over(by)}).where((F.col("i") <= want) & (F.col("sum") <= share))
    out: dict = {g: [] for g in groups}
    for g, h, t in once.select("g", "h", "t").toLocalIterator():
        out[g].append((h, t))
    return {g: [t for _, t in sorted(x)] for g, x in out.items()}


def bounded_sample(rows: DataFrame, group: str, text: str, want: int, most_groups: int = MOST_GROUPS, most_bytes: int = MOST_BYTES) -> dict:
    """About ``want`` distinct texts of each value of ``group``, chosen by the texts' hash and so alike on every run and partitioning.

    Bounds: ``most_groups`` groups, ``want`` texts a group, and ``most_bytes`` in all.
    """
    counts = {r[0]: r[1] for r in rows.where(F.col(group).isNotNull() & F.col(text).isNotNull()).groupBy(group).count().orderBy(F.desc("count"), group).limit(most_groups).collect()}
    if not counts:
        return {}
    chosen = rows.where(F.pmod(F.xxhash64(text), F.lit(_RANGE)) < _threshold(counts, group, want)).select(F.col(group).alias("g"), F.col(text).alias("t"))
    return _in_hash_order(chosen, list(counts), want, most_bytes)


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, key: str, text: str, label: str, want: int, most_bytes: int = MOST_BYTES) -> tuple[dict[int, list[str]], float | None]:
    """Up to ``want`` texts for each of the labels 0 and 1, and the share of label 1 among the labelled ids where ``learn`` holds.

    Ids are chosen on the label table by their hash, ``want`` of each label, so
    the list that meets the documents has that bound and texts are not shuffled.
    ``learn`` is a condition on the key.
    """
    known = labels.where(learn).select(F.col(key).alias("k"), F.col(label).cast("int").alias("g")).where("k is not null and g in (0, 1)").distinct()
    counts = {r[0]: r[1] for r in known.groupBy("g").count().collect()}
    if not counts:
        return {}, None
    near = known.where(F.pmod(F.xxhash64("k"), F.lit(_RANGE)) < _threshold(counts, "g", want))
    chosen = near.withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("k"), "k"))).where(F.col("i") <= want).select("k", "g")
    rows = docs.where(learn & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).join(F.broadcast(chosen), "k").select("g", "t")
    return _in_hash_order(rows, sorted(counts), want, most_bytes), counts.get(1, 0) / sum(counts.values())
