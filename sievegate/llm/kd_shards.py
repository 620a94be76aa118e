"""K-d tree partitioning into shards of near equal bytes, in DataFrame operations only.

A node with more than one shard is split at the weighted median of its widest
dimension (its extent against the root's), with as much of the bytes to each
side as that side has shards, until each leaf holds one shard's share. Medians
come from histograms: each pass sums the bytes of ``BINS`` bins for every open
node and narrows each node to the bin that holds its median; what stands on one
coordinate is told apart by a hash. The driver sees bins, never rows.

The dimensions are metadata of the text (bytes, words, lines and marks that are
neither letters nor blanks), so rows with equal texts have one place in the tree and fall
into one shard. A group of copies that is larger
than a share is first cut into pieces by the hash of its keys, as no law of
equal bytes could hold else; there are fewer such groups than shards.

Law: ``bytes``. Defined cases: a null text has size 1, checksum 0 and no words; null keys
and repeated rows are rows like others; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Store

BINS = 2048
PIECES = 256
#: A bin with less of its node's bytes than this is not narrowed further.
FINE = 1e-4
#: Dimensions of the tree.
DIMS = ["size", "words", "lines", "marks"]
MARKS = "".join(chr(b) for b in range(33, 127) if not chr(b).isalpha())
#: Rows a slot window sees on average.
RUN = 20_000


def _cut_side(dim: str, value: int, tie: int) -> Column:
    """True for what goes left: below the value, or at it and below the tie."""
    return (F.col(dim) < value) | ((F.col(dim) == value) & (F.col("tie") < tie))


def kd_cuts(atoms: DataFrame, dims: list[str], shards: int) -> list[tuple[int, int, int, str, int, int]]:
    """Cuts (depth, node, left node, dimension, value, tie) for ``atoms`` (dims, tie, bytes); nodes are named by their first shard."""
    todo, cuts, depth = {0: shards}, [], 0
    root: dict[str, tuple[int, int]] = {}
    place = F.lit(0)
    while any(n > 1 for n in todo.values()):
        at = atoms.withColumn("node", place)
        spans = at.groupBy("node").agg(F.sum("bytes").alias("bytes"), *(f(d).alias(f"{k}_{d}") for d in dims for k, f in (("lo", F.min), ("hi", F.max)))).collect()
        spans = {r["node"]: r for r in spans}
        if depth == 0 and spans:
            root = {d: (spans[0][f"lo_{d}"], spans[0][f"hi_{d}"]) for d in dims}
        open_: dict[int, dict] = {}
        for node, n in todo.items():
            if n > 1 and node in spans:
                r = spans[node]
                wide = lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / max(1, root[d][1] - root[d][0])  # noqa: B023, E731
                dim = max(dims, key=wide)
                open_[node] = {"dim": dim, "on": dim, "lo": r[f"lo_{dim}"], "hi": r[f"hi_{dim}"], "want": r["bytes"] * (n // 2) / n, "all": r["bytes"], "fixed": None}
        pending = dict(open_)
        while pending:
            # each open node: the bin of its current column between its current bounds
            bin_ = F.lit(None).cast("long")
            for node, s in pending.items():
                width = (s["hi"] - s["lo"]) // BINS + 1
                here = (F.col("node") == node) & F.col(s["on"]).between(s["lo"], s["hi"])
                if s["fixed"] is not None:
                    here &= F.col(s["dim"]) == s["fixed"]
                bin_ = F.when(here, F.floor((F.col(s["on"]) - F.lit(s["lo"])) / F.lit(width)) if width == 1 else F.expr(f"({s['on']} - {s['lo']}L) div {width}L")).otherwise(bin_)
            sums: dict[int, list[tuple[int, int]]] = {}
            for r in at.withColumn("bin", bin_).where("bin is not null").groupBy("node", "bin").agg(F.sum("bytes").alias("bytes")).collect():
                sums.setdefault(r["node"], []).append((r["bin"], r["bytes"]))
            for node, s in list(pending.items()):
                width, below = (s["hi"] - s["lo"]) // BINS + 1, 0
                for b, size in sorted(sums[node]):
                    if below + size >= s["want"] or b == max(x for x, _ in sums[node]):
                        break
                    below += size
                start = s["lo"] + b * width
                nearer_after = s["want"] - below > below + size - s["want"]
                if width > 1 and size > FINE * s["all"]:
                    s |= {"lo": start, "hi": min(s["hi"], start + width - 1), "want": s["want"] - below}
                elif s["on"] != "tie" and width == 1 and size > FINE * s["all"]:
                    s |= {"fixed": start, "on": "tie", "lo": 0, "hi": (1 << 62) - 1, "want": s["want"] - below}
                else:
                    edge = start + width if nearer_after else start
                    value, tie = (s["fixed"], edge) if s["on"] == "tie" else (edge, 0)
                    cuts.append((depth, node, node + todo[node] // 2, s["dim"], value, tie))
                    del pending[node]
        place = node_of(cuts)
        todo = {k: v for node, n in todo.items() for k, v in (((node, n // 2), (node + n // 2, n - n // 2)) if n > 1 else ((node, n),))}
        depth += 1
    return cuts


def node_of(cuts: list[tuple[int, int, int, str, int, int]]) -> Column:
    """The leaf of a row, as one native expression nested like the tree."""
    by = {(d, n): (right, dim, value, tie) for d, n, right, dim, value, tie in cuts}

    def at(depth: int, node: int) -> Column:
        if (depth, node) not in by:
            return F.lit(node)
        right, dim, value, tie = by[depth, node]
        return F.when(_cut_side(dim, value, tie), at(depth + 1, node)).otherwise(at(depth + 1, right))

    return at(0, 0)


def metadata(body: Column) -> list[Column]:
    """Words, lines and marks of a text as counts, by built-in functions."""
    n = F.length(body)
    blanks = n - F.length(F.translate(body, " \t\n\r", ""))
    lines = n - F.length(F.replace(body, F.lit("\n"), F.lit("")))
    marks = n - F.length(F.translate(body, MARKS, ""))
    return [F.when(n > 0, blanks + 1).otherwise(0).cast("long").alias("words"), F.when(n > 0, lines + 1).otherwise(0).cast("long").alias("lines"), marks.cast("long").alias("marks")]


def kd_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16) -> DataFrame:
    """Per row: key, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (null under this law)."""
    if shards < 1:
        raise ValueError("shards must be positive")
    store = Store(docs.sparkSession, "kd")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("row_key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("crc"), F.xxhash64(body).alias("same"), *metadata(body))
    rows = store.put("rows", rows)
    # size, checksum and hash tell texts apart; metadata follow from the text
    groups = store.put("groups", rows.groupBy("size", "crc", "same").agg(F.sum("size").alias("bytes")))
    total, many = groups.agg(F.sum("bytes"), F.count("*")).first()
    n = rows.count()
    # fewer groups than shards can be larger than a share
    large = groups.where(F.col("bytes") > (total or 0) / shards).select("size", "crc", "same", F.lit(True).alias("large"))
    rows = rows.join(F.broadcast(large), ["size", "crc", "same"], "left")
    piece = F.when(F.col("large"), F.pmod(F.xxhash64("row_key"), F.lit(PIECES))).otherwise(F.lit(0))
    tie = F.shiftrightunsigned(F.xxhash64("same", piece), 2)
    rows = rows.select("row_key", "crc", tie.alias("tie"), *DIMS)
    atoms = store.put("atoms", rows.groupBy(*DIMS, "tie").agg(F.sum("size").alias("bytes")))
    cuts = kd_cuts(atoms, DIMS, shards) if n else []
    runs = max(1, -(-n // (RUN * shards)))
    rows = store.put("placed", rows.withColumn("shard", node_of(cuts).cast("int")).withColumn("run", F.pmod(F.xxhash64("row_key", "crc"), F.lit(runs))))
    counts = rows.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = counts.selectExpr("shard", "run", "sum(n) over (partition by shard order by run) - n as before")
    numbered = rows.selectExpr("*", "row_number() over (partition by shard, run order by row_key, crc, size) - 1 as own")
    out = numbered.join(before, ["shard", "run"])
    return out.select(F.col("row_key").alias(key), "size", F.col("crc").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
