import hashlib
import random
import struct
import sys

import numpy as np
import public_tokenizers
import pytest

from sievegate.llm.bpe import PairIndexBPE, bpe_decode, bpe_digests, bpe_encode
from sievegate.llm.exact_topk import exact_topk

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", " ", "Hello, World!  It's 2024 \n\n I'LL don't", "<|startoftext|>Ça va<|endoftext|> <|other|> x<|endoftext|>", "ΑΣ ΟΔΟΣ İstanbul ẞ", "é    \x1c a\x85b", "日本語 ١٢٣ ½ 🙂👩‍👩‍👧 ....", "aaaaaaaaaaaaaaaaaaaa", "ciónñ ÉTÉ naïve", "'s 't 're'VE ''''", "\0\x01 a\0b"]


def test_equals_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    chars = "abcdeé ÑñÀ'st.,!\n\t0123<|>ŞΣ́‍"
    texts = TEXTS + ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(300)]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    with open(PATH) as f:
        assert PairIndexBPE(f.read()).encode(texts) == want
    df = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string").selectExpr("*", "1 as ids")
    got = bpe_encode(df, PATH)
    assert {r.doc_id: r.ids for r in got.collect()} == {**dict(enumerate(want)), None: []}
    back = {r.doc_id: r.decoded for r in bpe_decode(got, PATH).collect()}
    assert all(back[i] == tok.decode(ids, skip_special_tokens=False) for i, ids in enumerate(want))
    for r in bpe_digests(df.where("doc_id is not null"), PATH).collect():
        ids = want[r.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize(("k", "lists", "block"), [(10, 4, 4096), (3, 2, 2), (60, 8, 5)])
def test_topk(spark, k, lists, block):
    rng = np.random.default_rng(k)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(150, 170)] + [(200, None), (201, [1.0, None]), (202, [float("nan")]), (203, [float("inf")]), (204, [0.5]), (None, [1.0]), (205, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = exact_topk(df, df.where("vec_id % 20 = 0"), k=k, lists=lists, block=block).collect()
    good = [(i, np.pad(np.floor(1024 * np.array(v, dtype=np.float32).astype(float)), (0, 8 - len(v)))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, v in good:
        if i % 20 == 0:
            best = sorted(((-int(v @ w), j) for j, w in good if j != i))[:k]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert exact_topk(df, df.limit(0)).count() == 0


@pytest.mark.parametrize("k", [3, 10])
def test_topk_repeated_rows(spark, k):
    rng = np.random.default_rng(k)
    centre = rng.normal(size=(6, 8)) * 3
    rows = [(i, [float(x) for x in centre[i % 6] + rng.normal(size=8) / 4]) for i in range(120)]
    rows = rows * 3 + [(i, [float(x) for x in rng.normal(size=8) * 3]) for i in range(1, 120, 7) if i % 20 for _ in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = exact_topk(df, df.where("vec_id % 20 = 0"), k=k).collect()
    good = [(i, np.floor(1024 * np.array(v, dtype=np.float32).astype(float))) for i, v in rows]
    want = []
    for i, v in dict(good).items():
        if i % 20 == 0:
            best = sorted((-int(v @ w), j) for j, w in good if j != i)[:k]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_topk_tasks_without_candidates(spark):
    rows = [(i, [float(-i), 1.0, float(-i), 2.0]) for i in range(2, 60)] + [(0, [1.0] * 4), (1, [9.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = exact_topk(df, df.where("vec_id = 0"), k=1).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 36 << 20)]


def test_candidates_are_pruned_before_they_are_resolved():
    from sievegate.llm.exact_topk import resolved, sufficient

    rng = np.random.default_rng(4)
    rows, queries = np.floor(rng.normal(size=(3000, 32)) * 900), np.floor(rng.normal(size=(20, 32)) * 900)
    groups = np.array_split(np.arange(32), 4)
    exact = rows @ queries.T
    low = np.stack([(rows[:, g] @ queries[:, g].T).min(axis=0) for g in groups])
    cutoff = np.sort(exact, axis=0)[-10]
    shifted = cutoff - low.sum(axis=0)
    x, y, known, sent = sufficient(rows, queries, groups, low, shifted)
    assert len(x) < exact.size
    x, y, score, looked = resolved(rows, queries, groups, low, shifted, x, y, known, sent)
    assert looked < 2 * exact.size  # of four entries a pair
    want = np.nonzero(exact >= cutoff)
    assert sorted(zip(x.tolist(), y.tolist(), score.tolist(), strict=True)) == sorted(zip(want[0].tolist(), want[1].tolist(), exact[want].tolist(), strict=True))


def test_topk_clashing_columns_and_empty_tables(spark):
    rows = [(i, [float(i), 1.0], 1, "q", 0.5, 7) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, query_id string, score double, row long")
    assert [r.vec_id for r in exact_topk(df, df.where("vec_id = 0"), k=2).orderBy("rank").collect()] == [1, 2]
    assert exact_topk(df.limit(0), df.where("vec_id = 0")).count() == 0


def test_bpe_empty_table_and_very_long_text(spark):
    from tokenizers import Tokenizer

    df = spark.createDataFrame([(1, "a very long text, " * 120_000)], "doc_id long, text string").selectExpr("*", "1 as n_tokens", "'x' as decoded")
    assert bpe_digests(df.limit(0), PATH).count() == 0 and bpe_encode(df.limit(0), PATH).count() == 0
    want = Tokenizer.from_file(PATH).encode("a very long text, " * 120_000, add_special_tokens=False).ids
    assert bpe_encode(df, PATH).first().ids == want and bpe_digests(df, PATH).first().n_tokens == len(want)


def test_bpe_merges_all_places_of_a_rank_at_once():
    """The interpreter's calls follow the ranks in use and the words, not the symbols; the result is the library's."""
    from tokenizers import Tokenizer

    rng = random.Random(8)
    parts = ["th", "in", "er", "an", "tion", "ble", "ou", "st", "ñé", "a", "aa", "ly", "ed", "x", "日", "12", "!!"]
    words = sorted({"".join(rng.choice(parts) for _ in range(rng.randrange(3, 12))) for _ in range(30_000)})
    text = " ".join(words)
    with open(PATH) as f:
        model = PairIndexBPE(f.read())
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        got = model.encode([text])
    finally:
        sys.setprofile(None)
    assert got == [Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids]
    assert calls < len(text.encode())  # some 20 bytes a word
