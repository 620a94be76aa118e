"""Toxicity by weak supervision.

Many voters look at a text: one for each entry of a lexicon (seed words, and the
words and word beginnings most typical of labelled toxic texts) and some for
patterns (several distinct entries, many for the text's length, an entry beside
a second-person word, shouting). A voter that does not fire abstains; one voter says "clean" where no lexicon word is
found. A generative label model estimates the voters' accuracies and their
correlations within the classes (along a forest of the strongest ones) by
expectation maximisation. A linear classifier is then trained on the model's
posterior labels, over words and patterns, and a scale on labelled rows turns its output into
probabilities.

Everything is fitted on the driver from bounded samples; whole texts are
scored. Words are runs of letters, lower-cased in ASCII. Defined cases: null
and empty texts get the score of a text without features; keys play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import fit_scale
from .sampling import bounded_sample, labelled_sample
from .store import bounded_batches, free_name
from .texts import LETTER, Rolling, U64, byte_view, chunks, lower_ascii, release, tidied, words

SAMPLE = 3000
#: Words of the lexicon and of the linear classifier.
LEXICON = 300
FEATURES = 150
#: Twice the log likelihood ratio from which a word of labelled toxic texts joins the lexicon.
EVIDENCE = 24.0

#: Seed words, insults in the languages at hand.
SEEDS = ["idiot", "moron", "scum", "stupid", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile", "loser", "vermin", "garbage", "idiota", "estúpido", "basura", "imbécil", "payaso", "crétin", "ordure", "abruti", "dummkopf", "abschaum", "trottel", "müll"]
_YOU = ["you", "your", "tu", "vous", "du", "ihr", "usted", "te"]


#: Lengths in bytes of the word beginnings that count beside whole words.
PREFIXES = (4, 5, 6, 7, 8)
_BEGIN = U64(0xD6E8FEB86659FD93)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and their rows, in text order."""
    low = lower_ascii(data)
    start, stop, row = words(low, offsets, LETTER)
    return (Rolling(low).of(start, stop) if len(start) else np.zeros(0, dtype=U64)), row


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of their beginnings, with rows; a row's words come in text order."""
    low = lower_ascii(data)
    start, stop, row = words(low, offsets, LETTER)
    if not len(start):
        return np.zeros(0, dtype=U64), row
    rolling = Rolling(low)
    hashes, rows = [rolling.of(start, stop)], [row]
    for n in PREFIXES:
        long = np.flatnonzero(stop - start > n)
        hashes.append(rolling.of(start[long], start[long] + n) ^ _BEGIN)
        rows.append(row[long])
    return np.concatenate(hashes), np.concatenate(rows)


def _bytes_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    return raw, np.array([0, len(raw)])


def hash_of(word: str) -> int:
    return int(word_hashes(*_bytes_of(word))[0][0])


_YOU_HASHES = np.unique(np.array([hash_of(w) for w in _YOU], dtype=U64))


def doc_features(text: str | None) -> np.ndarray:
    return np.unique(word_features(*_bytes_of(text))[0])


def _counts(docs: list[np.ndarray], weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if not docs:
        return np.zeros(0, dtype=U64), np.zeros(0)
    keys, back = np.unique(np.concatenate(docs), return_inverse=True)
    w = np.ones(len(docs)) if weight is None else weight
    return keys, np.bincount(back, weights=np.repeat(w, [len(d) for d in docs]), minlength=len(keys))


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def choose_lexicon(toxic: list[np.ndarray], clean: list[np.ndarray], size: int = LEXICON, least: float = EVIDENCE) -> np.ndarray:
    """Seeds, and the words and beginnings most typical of toxic texts; each of these needs clear odds and a likelihood ratio that chance does not give among so many words."""
    keys, a = _counts(toxic)
    other, m = _counts(clean)
    b = _lookup(other, m, keys)
    share = len(toxic) / max(1, len(toxic) + len(clean))
    odds = np.log((a + 0.25) / max(1, len(toxic))) - np.log((b + 0.25) / max(1, len(clean)))
    ratio = 2 * (a * np.log(a / ((a + b) * share)) + b * np.log(np.maximum(b, 1e-9) / ((a + b) * max(1 - share, 1e-9))))
    good = np.flatnonzero((odds > 2.0) & (ratio > least))
    best = keys[good[np.lexsort((keys[good], -ratio[good]))][:size]]
    seeds = np.array([hash_of(w) for w in SEEDS], dtype=U64)
    hurt = (_lookup(other, m, seeds) / max(1, len(clean))) > (_lookup(keys, a, seeds) / max(1, len(toxic)))
    return np.unique(np.concatenate((best, seeds[~hurt])))


def presence(docs: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    out = np.zeros((len(docs), len(known)))
    for r, d in enumerate(docs):
        if len(d) and len(known):
            at = np.minimum(np.searchsorted(known, d), len(known) - 1)
            out[r, at[known[at] == d]] = 1.0
    return out


def hit_words(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: distinct words that are in the lexicon by themselves or by a beginning, and words in all."""
    low = lower_ascii(data)
    start, stop, row = words(low, offsets, LETTER)
    n = len(offsets) - 1
    if not len(start) or not len(lexicon):
        return np.zeros(n, dtype=np.int64), np.bincount(row, minlength=n)
    rolling = Rolling(low)
    whole = rolling.of(start, stop)
    hit = _among(lexicon, whole)
    for k in PREFIXES:
        long = np.flatnonzero(stop - start > k)
        hit[long] |= _among(lexicon, rolling.of(start[long], start[long] + k) ^ _BEGIN)
    at, h = row[hit], whole[hit]
    order = np.lexsort((h, at))
    fresh = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (at[order][1:] != at[order][:-1]))) if len(at) else np.zeros(0, dtype=bool)
    return np.bincount(at[order][fresh], minlength=n), np.bincount(row, minlength=n)


def _among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted


#: Patterns: so many distinct lexicon words, and so many for each hundred words.
COUNTS = (2, 3, 5)
DENSE = (0.5, 2.0)


def patterns(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Per row and pattern whether it is met: several lexicon words, many of them for the length, one beside a second-person word, one in a shouting text."""
    many, total = hit_words(data, offsets, lexicon)
    n = len(offsets) - 1
    h, row = word_hashes(data, offsets)
    you = np.bincount(row[_among(_YOU_HASHES, h)], minlength=n) > 0 if len(h) else np.zeros(n, dtype=bool)
    upto = lambda kind: np.concatenate(([0], np.cumsum(kind)))
    upper, letter = upto((data >= 65) & (data <= 90)), upto(((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122)))
    shout = (upper[offsets[1:]] - upper[offsets[:-1]]) > 0.3 * np.maximum(1, letter[offsets[1:]] - letter[offsets[:-1]])
    some = many > 0
    return np.stack([*(many >= c for c in COUNTS), *(100 * many >= d * np.maximum(total, 1) for d in DENSE), some & you, some & shout], axis=1) & some[:, None]


def votes(docs: list[np.ndarray], raw: list[str], lexicon: np.ndarray) -> np.ndarray:
    """1 toxic, -1 clean, 0 abstains; a column for each voter: lexicon entries, patterns, and silence of the lexicon."""
    hits = presence(docs, lexicon)
    met = np.concatenate([patterns(*_bytes_of(t), lexicon) for t in raw]) if raw else np.zeros((0, len(COUNTS) + len(DENSE) + 2), dtype=bool)
    return np.concatenate((hits.astype(np.int8), met.astype(np.int8), -(hits.sum(axis=1) == 0).astype(np.int8)[:, None]), axis=1)


def _pair_counts(fired: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weight in all, and of the rows where one voter, and where two voters fire."""
    return float(weight.sum()), weight @ fired, (fired * weight[:, None]).T @ fired


def _information(counts: list[tuple[float, np.ndarray, np.ndarray]], pull: float = 2.0) -> np.ndarray:
    """Information that each two voters have of each other given the class, in nats times rows."""
    out = np.zeros_like(counts[0][2])
    for total, one, both in counts:
        rate = (one + 0.5) / (total + 1.0)
        for x in (False, True):
            for y in (False, True):
                n = both if x and y else one[:, None] - both if x else one[None, :] - both if y else total - one[:, None] - one[None, :] + both
                alone = np.outer(rate if x else 1 - rate, rate if y else 1 - rate)
                share = (np.maximum(n, 0) + pull * alone) / (total + pull)
                out += total * share * np.log(share / alone)
    np.fill_diagonal(out, 0)
    return out


def _forest(gain: np.ndarray, least: float) -> np.ndarray:
    """The forest of largest gain, from pairs that gain more than ``least``: each voter's parent, or -1."""
    m = len(gain)
    parent, best, by, todo = np.full(m, -1), np.full(m, -np.inf), np.full(m, -1), np.ones(m, dtype=bool)
    for _ in range(m):
        j = int(np.flatnonzero(todo)[np.argmax(best[todo])])
        parent[j], todo[j] = by[j] if best[j] > least else -1, False
        nearer = todo & (gain[j] > best)
        best[nearer], by[nearer] = gain[j][nearer], j
    return parent


def fit_label_model(vote: np.ndarray, prior: float, known: np.ndarray | None = None, rounds: int = 40, pull: float = 2.0) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Posterior of "toxic" for each row, and the parameters: accuracies and correlations.

    The class draws the votes along a forest over the voters: a voter fires at a
    rate that depends on the class (its accuracy) and on whether its parent in
    the forest fired (their correlation within the class). The forest joins the
    pairs with the most information of each other given the class, as far as
    that outweighs two more parameters. All are estimated by expectation
    maximisation; ``pull`` rows draw a correlated rate towards the voter's own.
    ``known`` has 0 or 1 for labelled rows, which hold the classes in place,
    else nan.
    """
    sure = ~np.isnan(known) if known is not None else np.zeros(len(vote), dtype=bool)
    fired = (vote != 0).astype(np.float64)
    toward = (vote > 0).any(axis=0)
    m = fired.shape[1]
    q = np.array([0.05, 0.35, 0.95])[(vote > 0).sum(axis=1).clip(0, 2)]  # start: one vote is a hint, two are a claim
    parent = np.full(m, -1)
    for step in range(rounds):
        guess, q = q, np.where(sure, np.clip(known, 0.02, 0.98), q) if known is not None else q
        counts = [_pair_counts(fired, 1 - q), _pair_counts(fired, q)]
        rate = np.stack([(one + 0.5) / (total + 1.0) for total, one, _ in counts])
        # a voter is better than chance in its own direction
        low, high = rate.min(axis=0), rate.max(axis=0)
        rate = np.where(toward, np.stack((low, high)), np.stack((high, low)))
        if step in (0, 3, 10):
            parent = _forest(_information(counts), np.log(len(fired)))
        has, up = parent >= 0, np.maximum(parent, 0)
        given = np.empty((2, 2, m))  # class, parent fired
        for c, (total, one, both) in enumerate(counts):
            joint = both[np.arange(m), up]
            given[c, 1] = (joint + pull * rate[c]) / (one[up] + pull)
            given[c, 0] = (one - joint + pull * rate[c]) / (total - one[up] + pull)
            given[c][:, ~has] = rate[c][~has]
        given = np.clip(given, 1e-6, 1 - 1e-6)
        yes, no = np.log(given[1] / given[0]), np.log((1 - given[1]) / (1 - given[0]))
        led = fired[:, up] * has
        score = np.log(prior / (1 - prior)) + np.where(led > 0, np.where(fired > 0, yes[1], no[1]), np.where(fired > 0, yes[0], no[0])).sum(axis=1)
        q = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if step > 10 and np.abs(q - guess).max() < 1e-4:
            break
    return q, {"rate": rate, "parent": parent, "given": given}


class ToxicityModel:
    """A lexicon, weights of words (by hash, sorted) and of the patterns of lexicon words, and an offset."""

    def __init__(self, lexicon: np.ndarray, words_: np.ndarray, weights: np.ndarray, pattern_weights: np.ndarray, offset: float) -> None:
        self.lexicon, self.words, self.weights, self.pattern_weights, self.offset = lexicon, words_, weights, pattern_weights, offset

    @classmethod
    def fit(cls, toxic: list[str], clean: list[str], loose: list[str], prior: float) -> ToxicityModel:
        kinds = len(COUNTS) + len(DENSE) + 2
        if not toxic and not clean:
            known = np.unique(np.array(list(map(hash_of, SEEDS)), dtype=U64))
            return cls(known, known, np.full(len(known), 4.0), np.zeros(kinds), -3.0)
        t, c, u = ([doc_features(x) for x in texts] for texts in (toxic, clean, loose))
        lexicon = choose_lexicon(t, c)
        every = [*u, *t, *c]
        vote = votes(every, [*loose, *toxic, *clean], lexicon)
        posterior, _ = fit_label_model(vote, min(max(prior, 0.01), 0.99), np.array([np.nan] * len(u) + [1.0] * len(t) + [0.0] * len(c)))
        # words that go with the posterior; the lexicon is among them
        keys, a = _counts(every, posterior)
        _, b = _counts(every, 1 - posterior)
        gain = (a / posterior.sum() - b / (1 - posterior).sum()) / np.sqrt((a + b + 1) / len(every))
        good = np.flatnonzero((a + b >= 3) & (gain > 0.05))
        known = np.unique(np.concatenate((lexicon, keys[good[np.lexsort((keys[good], -gain[good]))][:FEATURES]])))
        x = np.concatenate((presence(every, known), vote[:, len(lexicon) : len(lexicon) + kinds]), axis=1)
        w, b = _logistic(x, posterior)
        y = np.array([1.0] * len(t) + [0.0] * len(c))
        slope, shift = fit_scale(x[len(u) :] @ w + b, y)
        slope = max(slope, 1e-3)
        return cls(lexicon, known, w[: len(known)] * slope, w[len(known) :] * slope, float(b * slope + shift))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        h, row = word_features(data, offsets)
        g = self.offset + patterns(data, offsets, self.lexicon) @ self.pattern_weights
        if len(h) and len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[at] == h
            pair = np.unique(row[hit] * len(self.words) + at[hit])
            np.add.at(g, pair // len(self.words), self.weights[pair % len(self.words)])
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def _logistic(x: np.ndarray, target: np.ndarray, rounds: int = 800, rate: float = 0.1, l1: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels; the l1 term keeps words at zero that say nothing."""
    w, b = np.zeros(x.shape[1]), float(np.log((target.mean() + 1e-6) / (1 - target.mean() + 1e-6)))
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for step in range(1, rounds + 1):
        err = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - target
        grad = np.append(x.T @ err / len(x), err.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
    return w, b


def _score(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = byte_view(batch.column(batch.num_columns - 1))
            score = np.zeros(batch.num_rows)
            for i, j in chunks(off):
                score[i:j] = model.score(data[off[i] : off[j]], off[i : j + 1] - off[i])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], names=[*batch.schema.names[:-1], "score"])

    return tidied(run)


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Bound: ``sample`` texts each of toxic, clean and unlabelled rows where ``learn`` holds."""
    rows = docs.where(learn).select(F.col(text).cast("string").alias("t"))
    picked, prior = labelled_sample(docs, labels, learn, key, text, label, sample)
    loose = bounded_sample(rows.select("t", F.lit(0).alias("g")), "g", "t", sample).get(0, [])
    model = ToxicityModel.fit(picked.get(1, []), picked.get(0, []), loose, 0.1 if prior is None else prior)
    del picked, loose
    release()
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with a last column ``score`` in 0..1; a column of that name in docs is replaced."""
    bounded_batches(docs.sparkSession)
    kept = docs.drop("score")
    return kept.withColumn(free_name(kept, "_scan"), F.col(text).cast("string")).mapInArrow(_score(model), kept.schema.add("score", "double"))
