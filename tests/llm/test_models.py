import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from sievegate.llm.language import LanguageModel, fit_language, identify_language
from sievegate.llm.quality import QualityModel, fit_nnpu, fit_quality, score_quality
from sievegate.llm.queries import QUERIES
from sievegate.llm.toxicity import ToxicityModel, fit_label_model, fit_toxicity, score_toxicity

SF = "/root/testdata/sf0.01"


def test_nnpu_separates_without_negatives():
    rng = np.random.default_rng(0)
    pos = np.abs(rng.normal(size=(300, 40)) * 0.1 + 0.3)
    neg = np.abs(rng.normal(size=(80, 40)) * 0.1 + np.where(np.arange(40) < 20, 0.5, 0.1))
    w, b = fit_nnpu(pos[:150], np.concatenate((pos[150:], neg)), 150 / 230)
    assert np.median(pos @ w + b) > np.median(neg @ w + b) + 1


def test_batched_score_is_per_text():
    model = QualityModel(np.random.default_rng(1).normal(size=QualityModel.fit([], [], 0.5).weights.shape), 0.1, 0.5)
    tox = ToxicityModel.fit(["you idiot x", "moron y", "idiot z"] * 4, ["good day", "fine text"] * 6, ["plain words"] * 5, 0.5)
    texts = ["", "ab", "x", "the cat. the cat.\nthe cat.\n", "É", "an idiot"]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    for m in (model, tox):
        every = m.score(np.frombuffer(b"".join(raw), dtype=np.uint8), off)
        single = [m.score(np.frombuffer(r, dtype=np.uint8), np.array([0, len(r)]))[0] for r in raw]
        assert np.allclose(every, single)
    assert tox.score(np.frombuffer(raw[5], dtype=np.uint8), np.array([0, len(raw[5])]))[0] > 0.7


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(3)
    y = rng.random(2000) < 0.2
    vote = np.zeros((2000, 5), dtype=np.int8)
    for j, (hit, false) in enumerate(((0.6, 0.01), (0.5, 0.02), (0.4, 0.01), (0.3, 0.2))):
        vote[:, j] = rng.random(2000) < np.where(y, hit, false)
    vote[:, 4] = np.where((vote[:, :4] == 0).all(axis=1), -1, 0)
    q, found = fit_label_model(vote, 0.2)
    assert ((q > 0.5) == y).mean() > 0.85
    assert found["rate"][1, 0] > found["rate"][0, 0]


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    for name, rest, n, least in (("op1_quality", 0, 5, 0.95), ("op5_toxicity", 1, 3, 0.9), ("op4_language", 1, 3, 0.97)):
        rows = QUERIES[name](spark, SF).collect()
        assert len(rows) == docs.count()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == rest) and 0 <= r.score <= 1 for r in rows)
        held = [r for r in rows if r.held_out]
        if name == "op4_language":
            good = [r.lang_pred == lang[r.doc_id] for r in held]
        else:
            field = name.split("_")[1].replace("toxicity", "toxic")
            good = [r.predicted == labels[r.doc_id][field] for r in held if r.doc_id in labels]
        assert sum(good) / len(good) >= least, name


def test_edges(spark):
    rng = random.Random(0)
    rows = [(i, rng.choice(["hello there friend", "HEY!! HEY!! HEY!!", "bonjour mes amis"]), ["en", "fr", None][i % 3]) for i in range(60)]
    rows += [(None, None, None), (100, "", "en"), (101, "123 !?", "en"), (101, "123 !?", "en"), (102, "long " * 60000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as lang_pred", "3 as _scan")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(50)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    always = F.col("doc_id").isNotNull()
    for out in (score_quality(docs, fit_quality(docs, labels, always)), score_toxicity(docs, fit_toxicity(docs, labels, always))):
        got = out.collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    got = identify_language(docs, fit_language(docs, always)).collect()
    assert {r.lang_pred for r in got if r.text in (None, "", "123 !?")} == {"und"}
    assert {r.lang_pred for r in got} == {"en", "fr", "und"}
    none = docs.limit(0)
    assert identify_language(none, fit_language(none, always)).count() == 0
    assert score_quality(none, fit_quality(none, labels, always)).count() == 0
    assert score_toxicity(none, fit_toxicity(none, labels.limit(0), always)).count() == 0
    assert LanguageModel({}).predict("hello") == ("und", 0.0, True)


def test_prior_from_positives_and_unlabelled():
    from sievegate.llm.quality import WIDTH, estimate_prior

    rng = np.random.default_rng(8)
    for share in (0.3, 0.6, 0.85):
        good = lambda n: (np.abs(rng.normal(size=(n, WIDTH))) * (1 + (np.arange(WIDTH) < 300))).astype(np.float32)
        bad = lambda n: (np.abs(rng.normal(size=(n, WIDTH))) * (1 + (np.arange(WIDTH) >= WIDTH - 300))).astype(np.float32)
        n = 600
        loose = np.concatenate((good(int(n * share)), bad(n - int(n * share))))
        assert abs(estimate_prior(good(300), loose[rng.permutation(n)]) - share) < 0.12
    assert estimate_prior(np.zeros((2, WIDTH), dtype=np.float32), np.zeros((2, WIDTH), dtype=np.float32), 0.4) == 0.4


def test_samples_are_whole_texts_in_hash_order(spark):
    from sievegate.llm.sampling import bounded_sample

    rows = [("a", f"{i} " + "x" * (i % 50)) for i in range(400)] + [("a", "copied text")] * 500 + [("b", "y" * 3000), ("b", "short"), ("c", None), (None, "z")]
    df = spark.createDataFrame(rows, "g string, t string")
    got = bounded_sample(df, "g", "t", 100, most_bytes=32_000)
    assert set(got) == {"a", "b"} and got["b"] == ["short"] and 60 <= len(got["a"]) <= 100
    assert set(got["a"]) <= {t for _, t in rows} and len(set(got["a"])) == len(got["a"]) and got["a"] != sorted(got["a"])
    assert bounded_sample(df.repartition(7), "g", "t", 100, most_bytes=32_000) == got
    assert bounded_sample(df.limit(0), "g", "t", 100) == {}
