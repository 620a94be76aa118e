import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sievegate.llm.decontaminate import Needles, drop_contaminated, edits, find_contaminated
from sievegate.llm.kd_shards import kd_shards
from sievegate.llm.line_dedup import line_dedup

WORDS = [a + b + c for a in ("an", "the", "o", "ri", "st") for b in ("", "er", "tion") for c in ("", "ed", "ly", "ing")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# ---- line dedup


def lines_brute(rows, ratio=0.1, least=3):
    pages, has = Counter(), Counter()
    for _, t, h in rows:
        pages[h] += 1
        for x in {x.strip(" ") for x in (t or "").split("\n")} if t is not None else ():
            has[h, x] += bool(x)
    bad = {k for k, n in has.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for i, t, h in rows:
        if t is None:
            out.append((i, None, 0, 0))
        else:
            kept = [x for x in t.split("\n") if (h, x.strip(" ")) not in bad]
            out.append((i, "\n".join(kept), t.count("\n") + 1, t.count("\n") + 1 - len(kept)))
    return out


def test_line_dedup(spark):
    rng = random.Random(1)
    rows = [(0, None, "a"), (1, "", "a"), (2, " \n\n", None)]
    for i in range(3, 120):
        lines = [prose(rng, rng.randrange(1, 5)) for _ in range(rng.randrange(1, 9))]
        for p, x in ((0.3, "Menu | Home"), (0.05, "rare line")):
            if rng.random() < p:
                lines.insert(rng.randrange(len(lines) + 1), x + " " * rng.randrange(2))
        rows.append((i, "\n".join(lines), rng.choice(["a", "a", "b", None])))
    rows.append(rows[5])
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_dedup(df.selectExpr("*", "1 as h", "2 as lines"))
    key = lambda r: (r[0], str(r[1]))
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=key) == sorted(lines_brute(rows), key=key)
    assert line_dedup(df.limit(0)).count() == 0


# ---- shards


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_kd_shards(spark, shards):
    rng = random.Random(shards)
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(900)] + ["copy of " + prose(rng, 4)] * 40 + [None, ""]
    rows = list(enumerate(texts)) + [(None, "x y"), (7, texts[7])]
    out = kd_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shards=shards).collect()
    assert len(out) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    held, slots, home = Counter(), defaultdict(list), defaultdict(set)
    for r in out:
        held[r.shard] += r.size
        slots[r.shard].append(r.slot)
        home[r.size, r.text_crc32].add(r.shard)
    assert set(held) == set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in home.values())
    share = sum(held.values()) / shards
    assert max(abs(v - share) for v in held.values()) < 4 * 700


def test_kd_shards_one_giant_group(spark):
    rows = [(i, "same text for all") for i in range(4000)] + [(i, f"t{i}") for i in range(4000, 4100)]
    out = kd_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    held = Counter()
    for r in out:
        held[r.shard] += r.size
    assert max(held.values()) < 1.25 * min(held.values())
    assert kd_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- decontamination


def levenshtein_in(window, region):
    row = [0] * (len(region) + 1)
    for i, c in enumerate(window):
        new = [i + 1]
        for j, d in enumerate(region):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def normal(t):
    return re.sub(r"[ \t\n\x0b\x0c\r]+", " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")).encode()


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(7)
    items = [(k, prose(rng, rng.randrange(12, 50))) for k in range(6)] + [(90, None), (91, "tiny")]
    docs = []
    for i in range(60):
        text = prose(rng, rng.randrange(80))
        if i % 3 == 0:
            words = items[i % 6][1].upper().split(" ")
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            text = text + " \n " + "  ".join(words) + " " + prose(rng, 9)
        docs.append((i, text))
    docs += [(100, None), (101, ""), (100, None)]
    needles = Needles(items)
    want = {}
    for i, t in docs:
        want[i] = sorted({needles.item[w] for w in range(needles.many) if levenshtein_in(needles.text[w], normal(t)) <= needles.most[w]})
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'q' as item_id", "1 as items")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_contaminated(df, bench, block=300)
    assert {r.doc_id: r["items"] for r in got.collect()} == want
    assert any(want.values()) and not all(want.values())
    once = find_contaminated(df, bench)
    assert {r.doc_id: r["items"] for r in once.collect()} == want
    assert once._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    for kept in (drop_contaminated(df, bench), drop_contaminated(df, bench, block=300)):
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if not want[i])
    assert find_contaminated(df.limit(0), bench).count() == 0 and find_contaminated(df.limit(0), bench, block=300).count() == 0
    assert drop_contaminated(df, bench.limit(0)).count() == len(docs)


def test_dense_hits_are_not_cut():
    rng = random.Random(5)
    item = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(81))
    for many in (5407, 5409, 8119):
        data = np.frombuffer((item * many).encode(), dtype=np.uint8)
        found = Needles([(1, item)]).find(data, np.arange(many + 1) * len(item))
        assert {r for r, _, _, _ in found} == set(range(many))


def test_many_documents_of_one_item(spark):
    rng = random.Random(15)
    item = prose(rng, 14)
    df = spark.range(10_802).selectExpr("id as doc_id", f"'{item}' as text")
    assert find_contaminated(df.coalesce(1), spark.createDataFrame([(1, item)], "item_id long, text string")).where("contaminated").count() == 10_802


def test_leak_in_a_very_long_text(spark):
    rng = random.Random(16)
    item = prose(rng, 40)
    long = prose(rng, 250_000)
    rows = [(1, long + " " + item + " " + long), (2, long)]
    got = find_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted((r.doc_id, r["items"]) for r in got.collect()) == [(1, [7]), (2, [])]


def test_edits():
    rng = random.Random(2)
    for _ in range(200):
        w = "".join(rng.choice("ab") for _ in range(30)).encode()
        m = bytearray(w)
        for _ in range(rng.randrange(4)):
            p = rng.randrange(len(m))
            m[p : p + rng.randrange(2)] = rng.choice([b"a", b"b", b""])
        pad = "".join(rng.choice("xy") for _ in range(6)).encode()
        region = pad + bytes(m) + pad
        full = levenshtein_in(w, region)
        if full <= 6:
            assert edits(w, region, 12, 6) == full


def reference_tree(atoms, dims, shards):
    """The leaf of each atom (coordinates, tie, bytes): a node is cut at the weighted median of its widest dimension, ties by their hash."""
    leaf = {}
    extent = lambda part, d: max(a[0][d] for a in part) - min(a[0][d] for a in part)
    root = [max(1, extent(atoms, d)) for d in range(dims)]

    def cut(part, first, n):
        if n == 1 or not part:
            leaf.update({(a[0], a[1]): first for a in part})
            return
        d = max(range(dims), key=lambda d: extent(part, d) / root[d])
        part = sorted(part, key=lambda a: (a[0][d], a[1]))
        want, below = sum(a[2] for a in part) * (n // 2) / n, 0
        for i, a in enumerate(part):
            if below + a[2] >= want or i == len(part) - 1:
                break
            below += a[2]
        at = i + 1 if want - below > below + a[2] - want else i
        cut(part[:at], first, n // 2)
        cut(part[at:], first + n // 2, n - n // 2)

    cut(atoms, 0, shards)
    return leaf


@pytest.mark.parametrize("shards", [2, 5, 8])
def test_kd_cuts_equal_reference_tree(spark, shards):
    from sievegate.llm.kd_shards import kd_cuts, node_of

    rng = random.Random(shards)
    spots = [(rng.randrange(5000), rng.randrange(40), rng.randrange(9)) for _ in range(120)]
    atoms = [(s, rng.randrange(1 << 62), rng.randrange(1, 90)) for s in spots + spots[:40] * 2]
    df = spark.createDataFrame([(*s, t, b) for s, t, b in atoms], "size long, words long, lines long, tie long, bytes long")
    cuts = kd_cuts(df, ["size", "words", "lines"], shards)
    got = {((r["size"], r.words, r.lines), r.tie): r.leaf for r in df.withColumn("leaf", node_of(cuts)).collect()}
    assert got == reference_tree(atoms, 3, shards)


def test_kd_shards_clashing_columns_and_very_long_text(spark):
    rows = [(i, f"text {i} " * 9, 1, "x") for i in range(200)] + [(500, "long text " * 200_000, 2, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size int, shard string")
    out = kd_shards(df, shards=4).collect()
    assert len(out) == len(rows) and out[0].law == "bytes"
    assert kd_shards(df.limit(0), shards=4).count() == 0


def test_line_dedup_of_a_very_long_text(spark):
    long = "\n".join(f"line {i}" for i in range(150_000))
    rows = [(i, f"Menu\nbody {i}", "h") for i in range(12)] + [(50, long + "\nMenu", "h")]
    out = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[50] == (long, 1) and out[3] == ("body 3", 1)


def test_tables_are_cleared(spark):
    import os

    from sievegate.llm.store import _FOLDERS, Store, clear

    store = Store(spark, "t")
    store.put("x", spark.range(3))
    path = store.path.removeprefix("file://") + "/x"
    assert os.path.isdir(path) and store.path in _FOLDERS
    clear(spark)
    assert not os.path.isdir(path) and not _FOLDERS
