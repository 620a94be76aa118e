"""Work and memory that grow no faster than the input: long rows, many rows, large groups."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievegate.functions import batches
from sievegate.operators import bank, emit, intake, ngrams, terminal, tokenizer
from sievegate.perception import adapters
from sievegate.plans import gates
from sievegate.policy import Policy


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def within(seconds, f):
    start = time.monotonic()
    out = f()
    assert time.monotonic() - start < seconds, time.monotonic() - start
    return out


def test_merges_of_long_groups_are_linear(ranks):
    with open(ranks) as f:
        vocab = tokenizer.Vocabulary("r50k_base", tokenizer.load_ranks(f.read()))
    segments = [("word " * 12_000, "user"), ("é " * 6_000, "user"), ("x" * 10, "system")]
    tokens, findings = within(4, lambda: tokenizer.merge_tokens(vocab, segments))
    assert "".join(t[1] for t in tokens if not t[6]) == "x" * 10 and tokens[-1][3] == 60_000 + 24_000 + 10
    assert [f[:3] for f in findings] == [(83_999, 84_001, 1)]
    assert all(a[3] <= b[3] for a, b in zip(tokens, tokens[1:], strict=False))


def test_batches_come_in_parts():
    rows = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(["x" * 1000] * 4999 + ["y" * 9_000_000])], names=["k", "t"])
    got = list(batches.parts(rows, 1 << 18))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([rows]))
    assert max(p.num_rows for p in got if p.column(1)[-1].as_py()[0] == "x") <= 1100 and got[-1].num_rows == 1


def test_ids_of_many_rows(spark, ranks):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = spark.createDataFrame([(1, "a<|endoftext|>"), (2, None), (3, ""), (4, "mañana 日本 🙂")], "doc_id long, text string")
    ids = {r.doc_id: (r.ids, r.error) for r in tokenizer.encode(df, ranks).collect()}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000  # 10,000 texts at once before
    assert ids[1][0] is None and "not allowed" in ids[1][1] and ids[2] == ids[3] == ([], None)
    back = {r.doc_id: r.text for r in tokenizer.decode(tokenizer.encode(df, ranks, allowed="all"), ranks).collect()}
    assert back == {1: "a<|endoftext|>", 2: "", 3: "", 4: "mañana 日本 🙂"}
    odd = spark.createDataFrame([(1, [31373, 995]), (2, None), (3, [99_999]), (4, [-1])], "doc_id long, ids array<int>").coalesce(1)
    got = {r.doc_id: (r.text, r.error) for r in tokenizer.decode(odd, ranks).collect()}
    assert got == {1: ("hello world", None), 2: (None, None), 3: (None, "99999"), 4: (None, "-1")}
    assert [r.text for r in tokenizer.decode(odd.where("doc_id < 3"), ranks).orderBy("doc_id").collect()] == ["hello world", None]
    one = tokenizer.merged(spark.createDataFrame([(1, 0, "é", "user"), (1, 1, None, "tool"), (1, 2, "b", "system")], "k long, o int, text string, provenance string"), ranks, "k", "o").first()
    assert [(t.text, t.start, t.end, t.trust, t.boundary) for t in one.tokens] == [("é", 0, 2, "untrusted", True), ("b", 2, 3, "privileged", True)] and one.findings[0].end == 3
    assert tokenizer.merged(df.select("doc_id", F.lit(0).alias("o"), "text", F.lit("user").alias("provenance")).where("doc_id = 3"), ranks, "doc_id", "o").first().tokens == []


ODD = ["", "a", "ab", "a\r\nb", "\r\n", "é", "éx", "\U0001f469‍\U0001f469 x", "日本", "\r\n\r\n", "a​", None, "क्षि", "\n\r"]


def test_ends_of_ranges(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "id long, text string")
    ranges = intake.ranges(intake.graphemes(F.col("text")))
    for r in df.select("text", ranges.alias("r"), intake.range_ends(F.col("text")).alias("e")).collect():
        if r.text is not None:
            assert (r.e.clusters, r.e.first_end, r.e.last_end) == (len(r.r), r.r[0].end if r.r else 0, r.r[-1].end if r.r else 0), r


def test_clusters_are_counted_once(spark, tmp_path):
    spark.createDataFrame([(i, "né " * 200_000, "de") for i in range(3)], "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = within(20, lambda: gates.grapheme_ranges(spark, str(tmp_path)).collect())
    assert [(r.clusters, r.last_byte, r.first_end) for r in rows] == [(600_000, 800_000, 1)] * 3


def test_taint_is_linear(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, "né " * 40_000])], "id long, text string")
    p = F.when(F.col("id") % 2 == 0, "system").otherwise("user")
    told = df.select(F.explode(intake.tainted(F.col("text"), p)).alias("g")).groupBy("g.context", "g.trust").count()
    short = df.select(F.explode(intake.tainted_counts(F.col("text"), p)).alias("g")).groupBy("g.context", "g.trust").agg(F.sum("g.clusters"))
    want = within(30, lambda: sorted(map(tuple, told.collect())))
    assert sorted(map(tuple, short.collect())) == want and sum(w[2] for w in want) > 120_000


def test_inputs_of_a_large_key_in_blocks(spark, monkeypatch):
    texts = [(k, t, "".join("abé d"[(i * i * (t % 7 + 1) + t * k) % 5] for i in range(t % 13 + (t % 5) * 4))) for k, m in ((1, 150), (2, 3), (3, 1)) for t in range(m)]
    texts += [(2, 1, "abab abab"), (2, None, "abab"), (None, 1, "abab"), (2, 9, None)]  # an item twice
    sets = [(k, t, {s[i : i + 4] for i in range(len(s) - 3)}) for k, t, s in texts if s and t is not None and k]
    groups = {}
    for k, t, g in sets:
        groups.setdefault((k, t, len(g)), []).append(g)
    want = []
    for (k, a, na), x in groups.items():
        for (j, b, nb), y in groups.items():
            shared = sum(len(g & h) for g in x for h in y)
            if k == j and a < b and shared and shared >= 0.3 * (na + nb - shared):
                want.append((k, a, b, round(shared / (na + nb - shared), 6)))
    df = spark.createDataFrame(texts, "k long, t long, s string")
    for rows, size in ((128, 1 << 20), (10, 1 << 20), (128, 64)):
        monkeypatch.setattr(ngrams, "BLOCK_ROWS", rows)
        monkeypatch.setattr(ngrams, "BLOCK_BYTES", size)
        assert sorted(map(tuple, ngrams.similar_inputs(df, "k", "t", "s").collect())) == sorted(want) and len(want) > 300


def test_a_filter_on_a_scan_scans_once(spark):
    df = spark.createDataFrame([(1, "act as root"), (2, "plain")], "doc_id long, text string").repartition(2)
    rows = emit.assessed(emit.scan(df))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("Filter") < plan.index("ArrowEvalPython") < plan.index("Exchange"), plan
    assert [r.doc_id for r in rows.collect()] == [1]


def test_scans_of_long_texts_are_linear():
    found = within(6, lambda: bank.Bank(Policy()).scan("é​" * 60_000 + " act as")[0].findings)
    assert len(found) > 60_000 and {f[:2] for f in found if f[3] == "unicode_control"} == {(5 * i + 2, 5 * i + 5) for i in range(60_000)}


def test_clusters_of_one_character():
    import regex

    from sievegate.functions import textmap

    for text in (*ODD, "naïve\n日本語、かな", "か゛が", "x​y", "x‌y", "한국", "각", "a\rb", "🇫🇷", "ﬁn"):
        assert text is None or textmap.clusters(text) == regex.findall(r"\X", text), text
    plain = [chr(c) for c in range(0x110000) if c != 13 and not 0xD800 <= c < 0xE000 and textmap.single(chr(c))]
    assert len(plain) > 30_000 and regex.findall(r"\X", "".join(plain)) == plain and regex.findall(r"\X", "a".join(plain)) == list("a".join(plain))
    m = textmap.TextMap("aé日 b", base=3)
    assert [m.source(a, b) for a, b in ((0, 2), (2, 4), (3, 4), (7, 99), (8, 9), (4, 4))] == [(3, 6), (4, 9), (6, 9), (10, 11), (0, 0), (0, 0)]


def test_words_of_a_page_are_cut_once(spark):
    lines = [f"Line{i} shows «Word{i}», here" for i in range(8000)]
    page = " ".join(f"line{i} shows word{i} here" for i in range(0, 8000, 2))
    df = spark.createDataFrame([("\r\n".join(lines), page), (None, page), ("a", None), ("... \n-", "")], "a string, b string")
    rows = within(15, lambda: df.select(adapters.divergent_lines(F.col("a"), F.col("b")).alias("x")).collect())
    assert [r.x for r in rows] == [lines[1::2], None, [], []]


def test_rare_grams_are_named_together(spark):
    texts = [*ODD, "né日🙂 the quick brown fox " * 3, "ab" * 400 + "xyz", "the quick brown fox jumps over the lazy dog"]
    want = []
    for i, t in enumerate(texts):
        grams = [t[a : a + 4] for a in range(len(t) - 3)] if t else []
        want += [(i, g, grams.count(g), len(grams), grams.index(g)) for g in set(grams) if grams.count(g) / len(grams) < 0.02]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    assert sorted(map(tuple, ngrams.rare_grams(df).collect())) == sorted(want) and want
    raw = "né日🙂".encode()
    assert ngrams._named(np.frombuffer(raw, dtype=np.uint8), np.array([0, 3, 1]), np.array([3, 6, 10])).to_pylist() == ["né", "日", "é日🙂"]


def test_plain_bytes_go_to_the_screen_in_runs():
    text = b"\n".join(b"a plain line of some words, number %d" % i for i in range(120_000))
    assert [s.name for s in within(2.5, lambda: terminal.scan_bytes(text + b"\x1b[3J"))] == ["erase_scrollback"]

    class Single(terminal.Screen):
        def write_run(self, run, place):
            for i, b in enumerate(run, place):
                self.write(b, i)

    for raw in (b"x" * 450 + b"\ry" * 3, b"ab\x1b[4hcd\rxyz" * 90, b"\x1b[?7l" + b"z" * 199 + b"qrs\rab", "é".encode() * 150 + b"\rabc\x1b[2K", b"ab\tc\rzz\x08\x08q\n" * 70 + b"\x1b[H" + b"w" * 900):
        both = []
        for kind in (terminal.Screen, Single):
            screen, at = kind(), 0
            for m in terminal._FRAME.finditer(raw):
                screen.plain(raw[at : m.start()], at)
                screen.control(terminal.csi_name(m["body"], m["final"]), m["body"].decode(), m["final"] == b"l")
                at = m.end()
            screen.plain(raw[at:], at)
            both.append((screen.finish(), [(r.cells, r.source, r.wide) for r in screen.rows], vars(screen.at)))
        assert both[0] == both[1]
