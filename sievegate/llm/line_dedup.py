"""Line dedup by site-relative frequency.

Lines are what newlines separate, read without blanks at their ends. For each
host, the pages that contain a line are divided by the pages of the host; lines
above ``ratio`` are boilerplate there and leave every page of the host. A line
must be on ``least`` pages at least, so that small hosts keep what is merely
rare, and lines without other characters than blanks always stay.

The boilerplate lines of one host number at most its mean lines a page divided
by ``ratio``, however many pages it has; one row a host holds them. Page counts
are summed before they move, so a hot host costs no more than its distinct
lines, and its pages are never gathered: hosts' lists go to the pages.

Defined cases: a null text stays null and has no lines; a null host is a host
of its own; a row is a page, so repeated rows count each; extra columns pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store, free_name

RATIO = 0.1
LEAST = 3
#: Bytes of boilerplate lists up to which they are sent to all tasks; larger ones are joined by host.
SMALL = 32 << 20


def _hashes(text: str):
    return F.transform(F.split(F.col(text), "\n"), lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))


def host_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """(host, lines): the hashes of each host's boilerplate lines."""
    rows = docs.select(F.col(host).alias("h"), F.col(text).cast("string").alias("t"))
    pages = rows.groupBy("h").agg(F.count("*").alias("pages"))
    lines = rows.select("h", F.explode(F.array_distinct(_hashes("t"))).alias("line")).where("line is not null")
    often = lines.groupBy("h", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return often.join(pages, often.h.eqNullSafe(pages.h)).where(F.col("n") > ratio * F.col("pages")).groupBy(often.h).agg(F.collect_list("line").alias("lines"))


def line_dedup(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST, counts: bool = True) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text; with ``counts`` also n_lines and n_dropped."""
    found = Store(docs.sparkSession, "lines").put("boilerplate", host_boilerplate(docs, host, text, ratio, least))
    size = found.agg(F.sum(F.size("lines") * 8 + F.coalesce(F.octet_length(F.col("h").cast("string")), F.lit(0)))).first()[0] or 0
    h, of = free_name(docs, "_h"), free_name(docs, "_lines")
    found = found.select(F.col("h").alias(h), F.col("lines").alias(of))
    lists = F.broadcast(found) if size <= SMALL else found
    joined = docs.join(lists, F.col(host).eqNullSafe(F.col(h)), "left")
    split = F.split(F.col(text), "\n")
    stays = lambda x: F.coalesce(~F.array_contains(F.col(of), F.xxhash64(F.trim(x))), F.lit(True)) | (F.trim(x) == "")
    left = F.filter(split, stays)
    new = F.when(F.col(of).isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    out = [new.alias(c) if c == text else F.col(c) for c in docs.columns]
    more = [
        F.when(F.col(text).isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.when(F.col(text).isNull() | F.col(of).isNull(), 0).otherwise(F.size(split) - F.size(left)).cast("long").alias("n_dropped"),
    ]
    return joined.select(*out, *(more if counts else []))


#: DuckDB: the same over ``documents``, with the texts' digests.
ORACLE = f"""
with lines as (
  select doc_id, source, text, string_split(text, chr(10)) as parts from documents
), pages as (select source, count(*) as pages from documents group by source),
once as (
  select doc_id, source, unnest(list_distinct(list_transform(parts, lambda x: trim(x, ' ')))) as line from lines
), often as (
  select o.source, o.line from (select source, line, count(*) as n from once where line <> '' group by source, line) o
  join pages p on o.source is not distinct from p.source where o.n >= {LEAST} and o.n > {RATIO} * p.pages
), lists as (select source, list(line) as found from often group by source),
done as (
  select l.doc_id, l.text, coalesce(len(l.parts), 0) as n_lines,
    list_filter(l.parts, lambda x: not coalesce(list_contains(f.found, trim(x, ' ')), false)) as kept
  from lines l left join lists f on l.source is not distinct from f.source
)
select doc_id, cast(n_lines as bigint) as n_lines, cast(n_lines - coalesce(len(kept), 0) as bigint) as n_dropped,
  md5(array_to_string(kept, chr(10))) as kept_md5
from done
"""
