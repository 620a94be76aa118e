import random

import numpy as np
import pytest

from sievegate.llm.parity_join import Bands, brute_force, ngram_join


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 5)))
    line = [word() for _ in range(12)]
    items = [None, "", "  \t", "One two", "one  TWO", "é"]
    for _ in range(40):
        base = [word() for _ in range(int(2 ** rng.uniform(1, 9)))]
        if rng.random() < 0.4:
            base = line + base
        items.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            near = list(base)
            for _ in range(rng.randrange(1 + len(near) // 40 + 1)):
                near[rng.randrange(len(near))] = word()
            items.append("\n".join(near))
    big = [word() for _ in range(100)]
    for _ in range(60):
        near = list(big)
        near[rng.randrange(100)] = word()
        items.append(" ".join(near))
    return list(enumerate(items))


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80), (2, 60)])
def test_equals_brute_force(spark, k, num):
    items = corpus()
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(df, words_=k, num=num).collect()}
    assert got == brute_force(items, k, num, 100)


def test_large_families_go_part_by_part(spark):
    items = corpus(8)
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(df, words_=3, num=75, family_size=2).collect()}
    assert got == brute_force(items, 3, 75, 100)


def chains(rng, short, long, steps):
    """Texts of distinct words, each with what is left without its first and without its last words."""
    items = []
    for c in range(120):
        base = [f"w{c}x{i}" for i in range(rng.randrange(short, long))]
        items += [" ".join(base), *(" ".join(base[i:]) for i in steps), *(" ".join(base[:-i]) for i in steps)]
    rng.shuffle(items)
    return list(enumerate(items))


def test_chains_of_short_texts(spark):
    items = chains(random.Random(1), 10, 18, (1,))
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(df, words_=4, num=85).collect()}
    assert got == brute_force(items, 4, 85, 100)


def test_heads_in_large_families(spark):
    items = chains(random.Random(2), 14, 40, (1, 2, 3))
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(df, words_=4, num=85, family_size=2).collect()}
    assert got == brute_force(items, 4, 85, 100)


def test_null_keys_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "A b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join(df).collect())
    assert got == [("2", 0, "2"), ("4", 2, "4"), ("4", 2, "4"), ("9", 2, "4"), ("None", 2, "None")]
    assert ngram_join(df.limit(0)).count() == 0


def test_similar_sets_share_a_key():
    rng, bands = np.random.default_rng(5), Bands(85, 100)
    for _ in range(300):
        n = int(2 ** rng.uniform(0, 10)) + 1
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        allowed = bands.most(2 * len(s))
        cut = int(rng.integers(0, allowed + 1)) if allowed else 0
        drop = cut // 2
        other = np.unique(np.concatenate((s[drop:], rng.integers(0, 2**63, cut - drop).astype(np.uint64))))
        both = len(np.intersect1d(s, other))
        if 100 * both >= 85 * (len(s) + len(other) - both) and cut:
            assert len(np.intersect1d(bands.keys(s), bands.keys(other)))


def test_middle_text_joins_two(spark):
    """A text, the same with words appended and with words put before it: each near the first, not always near each other."""
    rng, items, want = random.Random(5), [], {}
    for c in range(500):
        base = [f"w{c}x{i}" for i in range(rng.randrange(17, 63))]
        more = max(1, (len(base) - 3) * 15 // 85)
        three = [base, base + [f"a{c}x{i}" for i in range(more)], [f"b{c}x{i}" for i in range(more)] + base]
        three = [(3 * c + i, " ".join(w)) for i, w in enumerate(three)]
        want |= brute_force(three, 4, 85, 100)
        items += three
    rng.shuffle(items)
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(3)
    for size, block in ((20_000, 2048), (20_000, 2), (2, 2)):
        got = ngram_join(df, words_=4, num=85, family_size=size, family_block=block, part_block=block).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_blocks_of_parts(spark):
    items = corpus(9)
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(3)
    got = ngram_join(df, words_=3, num=75, family_bytes=0, part_block=3).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_force(items, 3, 75, 100)


def test_long_text_and_clashing_columns(spark):
    rng = random.Random(4)
    long = [f"w{rng.randrange(50_000)}" for _ in range(300_000)]
    rows = [(1, " ".join(long), 1, "x"), (2, " ".join(long[:-9]), 2, "y"), (3, " ".join(long[::2]), 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, component_id string")
    assert sorted((r.doc_id, r.component_id) for r in ngram_join(df).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_components(spark):
    from sievegate.llm.components import connected_components
    from sievegate.llm.store import Store

    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 500)] + [(777, x) for x in range(700, 800)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    want = {x: root(x) for pair in links for x in pair if root(x) != x}
    got = connected_components(spark.createDataFrame(links, "a long, b long"), Store(spark, "t"), "cc")
    rows = got.collect()
    assert len(rows) == len(want) and {r.node: r.component for r in rows} == want
    assert connected_components(spark.createDataFrame([], "a long, b long"), Store(spark, "t"), "cc").count() == 0


def test_blocks_of_families(spark):
    items = corpus(10)
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(3)
    got = ngram_join(df, words_=3, num=75, family_block=5).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_force(items, 3, 75, 100)
