import random

import numpy as np

from sievegate.llm.suffix_index import IndexFamily, brute_force, suffix_dedup


def corpus(seed=1, n=60, alphabet="abcd é"):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [text(90), text(50), text(130)]
    out = [None, "", "x", "a" * 200, "ab" * 120, shared[0], shared[0]]
    for _ in range(n):
        parts = [text(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared)[rng.randrange(20) :], text(rng.randrange(60))]
        out.append("".join(parts))
    return out + rng.sample(out, 5)


def rows(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_equals_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = sorted((i, *r) for i, r in enumerate(brute_force(texts, 40)))
    assert rows(suffix_dedup(df, length=40, gram=16, batch_bytes=700)) == want
    assert any(r[2] for r in want)
    # keys with more than two contexts are dealt anew
    assert rows(suffix_dedup(df, length=40, gram=10, wide=2)) == want


def test_null_repeated_rows_and_clashing_columns(spark):
    long = "".join(chr(97 + (i * i) % 23) for i in range(120))
    df = spark.createDataFrame([(None, long, 1, "q"), (None, long, 2, "q"), (3, None, 3, None), (3, "", 4, "")], "doc_id long, text string, t1 int, key string")
    got = suffix_dedup(df, length=40, gram=16).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == [(0, 0), (0, 0), (120, 120), (120, 120)]
    assert suffix_dedup(df.limit(0), length=40, gram=16).count() == 0


def test_family_levels():
    rng = np.random.default_rng(0)
    family, texts = IndexFamily(16), []
    for k in range(9):
        blob = rng.integers(97, 99, 300, dtype=np.uint8)
        family.add(blob, np.arange(len(blob) - 15))
        texts.append(blob.tobytes())
    grams = [t[i : i + 16] for t in texts for i in range(len(t) - 15)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    assert family.repeated.tolist() == [seen[g] > 1 for g in grams]
    sizes = [x.size for x in family.levels]
    assert sizes == sorted(sizes, reverse=True) and len(sizes) < 5


def test_equal_polynomial_hashes_are_no_repeats(spark):
    """Two texts whose difference is a multiple of every power of two up to 2**64 at every odd base."""
    diff = np.array([1], dtype=object)
    for n, times in ((16, 4), (32, 5), (400, 1)):
        for _ in range(times):
            factor = np.zeros(n + 1, dtype=object)
            factor[0], factor[n] = -1, 1
            diff = np.convolve(diff, factor)
    diff = np.concatenate((diff, np.zeros(640 - len(diff), dtype=object)))
    left = [79 + -(-int(d) // 2) for d in diff]
    right = [a - int(d) for a, d in zip(left, diff, strict=True)]
    assert all(32 <= x < 127 for x in left + right)
    texts = [bytes(left).decode(), bytes(right).decode()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((i, *r) for i, r in enumerate(brute_force(texts)))
    assert rows(suffix_dedup(df)) == want and [r[2] for r in want] == [0, 0]


def test_equals_brute_force_at_the_lengths_of_the_query(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklé") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(n) for n in (70, 75, 90, 160, 400)]
    texts = [None, "", prose(30), "a" * 900, "ab " * 300, shared[4], shared[4], shared[4]]
    for _ in range(60):
        parts = [prose(rng.randrange(120))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            parts += [s[rng.randrange(60) : len(s) - rng.randrange(60)], prose(rng.randrange(80))]
        texts.append(" ".join(parts))
    common = prose(90)  # a passage in most texts, each time with other surroundings
    texts += [f"{prose(40)} {common} {prose(40)}" for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = sorted((i, *r) for i, r in enumerate(brute_force(texts)))
    assert sum(r[2] > 0 for r in want) > 60 and sum(r[2] == 0 for r in want) > 10
    assert rows(suffix_dedup(df)) == want
    assert rows(suffix_dedup(df, wide=3, batch_bytes=3000, family_bytes=9000)) == want


def test_very_long_text(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefghij") for _ in range(2_500_000))
    texts = [long, "x" + long[700_000:701_000] + "y", long[:399]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(suffix_dedup(df))
    assert [r[2] for r in got] == [1000, 1000, 0] and [r[3] for r in got] == [1, 1, 0]
