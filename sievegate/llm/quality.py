"""Quality classifier by positive-unlabelled learning.

Trusted positives, unlabelled web text and a class prior are all that the
scorer learns from: it minimises the non-negative unbiased risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with logistic loss. The
prior is given, or estimated: the share of positives among labelled rows, if
positives and unlabelled rows allow that much.
Its scores then get a scale and an offset (logistic, on labelled rows), so that
they read as probabilities.

Features of a text are shares, hence the same for short and very long texts:
hashed byte trigrams, pairs of byte classes (upper case, digits, marks and so
on), and repetition (words that stand a few places before, word triples and
lines met before in the text). A text's score needs one weight per byte.

The model is fitted on the driver from bounded samples (``sample`` texts of
each kind); all texts are scored whole. Defined cases: null and empty texts
have no features and get the score of the offset; null keys and repeated rows
are rows like others; without positives the score is the prior (0.5 if that is
unknown too).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import bounded_sample, labelled_sample
from .store import bounded_batches, free_name
from .texts import Rolling, byte_view, chunks, mix64, release, tidied, words

BITS = 11
SAMPLE = 1500

#: Classes of bytes: other ASCII marks, letters a-z, A-Z, digits, blanks, line ends, parts of longer characters, common marks.
_CLASSES = np.array([6 if b >= 128 else 1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 5 if b in (10, 13) else 4 if b in (9, 32) else 7 if chr(b) in ".,;:'\"()-?" else 0 for b in range(256)])
REPEATS = 6
WIDTH = (1 << BITS) + 8 * 8 + REPEATS


def _ids(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The trigram feature that ends at each byte, and the feature of its pair of byte classes."""
    x = data.astype(np.uint32)
    one = np.concatenate((np.zeros(1, dtype=np.uint32), x[:-1]))
    two = np.concatenate((np.zeros(2, dtype=np.uint32), x[:-2]))[: len(x)]
    grams = ((x | one << np.uint32(8) | two << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    kind = _CLASSES[data]
    before = np.concatenate((np.zeros(1, dtype=kind.dtype), kind[:-1]))
    return grams.astype(np.int64), (1 << BITS) + before * 8 + kind


def repeats(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row: shares of words equal to the one before, to one 2-4 and 5-12 before; of triples, lines and words met before."""
    n = len(offsets) - 1
    out = np.zeros((n, REPEATS))
    rolling = Rolling(data)

    def again(h: np.ndarray, row: np.ndarray) -> np.ndarray:
        order = np.lexsort((h, row))
        same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
        return np.bincount(row[order][1:][same], minlength=n) / np.maximum(np.bincount(row, minlength=n), 1)

    start, stop, row = words(data, offsets)
    if len(start):
        h = rolling.of(start, stop)
        count = np.maximum(np.bincount(row, minlength=n), 1)
        for c, span in ((0, (1,)), (1, (2, 3, 4)), (2, range(5, 13))):
            hit = np.zeros(len(h), dtype=bool)
            for k in span:
                if len(h) > k:
                    hit[k:] |= (h[k:] == h[:-k]) & (row[k:] == row[:-k])
            out[:, c] = np.bincount(row[hit], minlength=n) / count
        inside = row[2:] == row[:-2]
        out[:, 3] = again(mix64(h[:-2] + mix64(h[1:-1] + mix64(h[2:])))[inside], row[2:][inside])
        out[:, 5] = again(h, row)
    start, stop, row = words(data, offsets, _IN_LINE)
    if len(start):
        out[:, 4] = again(rolling.of(start, stop), row)
    return out


_IN_LINE = np.array([b != 10 for b in range(256)])


def features(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), WIDTH), dtype=np.float32)
    for i, t in enumerate(texts):
        data = np.frombuffer((t or "").encode(), dtype=np.uint8)
        if len(data):
            for ids in _ids(data):
                out[i] += np.bincount(ids, minlength=WIDTH).astype(np.float32) / len(data)
            out[i, -REPEATS:] = repeats(data, np.array([0, len(data)]))[0]
    return out


def feature_scale(unlabelled: np.ndarray) -> np.ndarray:
    scale = 1.0 / (np.sqrt(np.einsum("ij,ij->j", unlabelled, unlabelled) / len(unlabelled)) + 1e-4)
    scale[1 << BITS : -REPEATS] *= 4  # few features of each text, so they may move faster than single trigrams
    scale[-REPEATS:] *= 16
    return scale.astype(np.float32)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 150, rate: float = 0.1, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and offset of the linear scorer of least non-negative risk, by Adam over all rows; the rows are scaled in place meanwhile."""
    scale = feature_scale(unlabelled)
    positive *= scale
    unlabelled *= scale
    w, b = _least_risk(positive, unlabelled, prior, rounds, rate, decay)
    positive /= scale
    unlabelled /= scale
    return w * scale, b


def _least_risk(p: np.ndarray, u: np.ndarray, prior: float, rounds: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    w, b = np.zeros(p.shape[1], dtype=np.float32), 0.0
    first, second, slow, slow2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    norm = np.float32(1.0 / np.sqrt(p.shape[1]))
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for step in range(1, rounds + 1):
        gp, gu = p @ w * norm + b, u @ w * norm + b
        negative = np.mean(np.logaddexp(0, gu)) - prior * np.mean(np.logaddexp(0, gp))
        dp = -sigmoid(-gp) * prior / len(gp)  # positives read as positive
        if negative >= 0:
            dp = dp - sigmoid(gp) * prior / len(gp)
            du = sigmoid(gu) / len(gu)
        else:  # the risk of negatives went below zero: step back from it
            dp, du = sigmoid(gp) * prior / len(gp), -sigmoid(gu) / len(gu)
        grad, gb = norm * (p.T @ dp.astype(np.float32) + u.T @ du.astype(np.float32)) + decay * w, float(dp.sum() + du.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        slow, slow2 = 0.9 * slow + 0.1 * gb, 0.999 * slow2 + 0.001 * gb**2
        fix, fix2 = 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (first / fix) / (np.sqrt(second / fix2) + 1e-9)
        b -= rate * (slow / fix) / (np.sqrt(slow2 / fix2) + 1e-9)
    return w * norm, b


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, start: float = 0.5) -> float:
    """Share of positives among unlabelled rows, from both alone.

    A scorer is fitted on half of each; on the other halves, the share of
    unlabelled rows above a score is at least the prior times the share of
    positives there, so the smallest ratio, where positives are not too few for
    it to be sure, bounds the prior, and is it where no negative scores as high.
    """
    if len(positive) < 8 or len(unlabelled) < 8:
        return start
    half = lambda x, k: x[k::2].copy()
    w, b = fit_nnpu(half(positive, 0), half(unlabelled, 0), start, rounds=60)
    p, u = np.sort(half(positive, 1) @ w + b), np.sort(half(unlabelled, 1) @ w + b)
    at = np.quantile(p, np.linspace(0.02, 0.8, 40))
    above = lambda x: 1 - np.searchsorted(x, at, side="left") / len(x)
    mine, all_ = above(p), above(u)
    slack = np.sqrt(all_ * (1 - all_) / len(u)) / mine  # one standard error, so that the least of many is not too small
    return float(np.clip(np.min(all_ / mine + slack), 0.01, 0.99))


def fit_scale(score: np.ndarray, label: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset of a logistic curve through labelled scores, by Newton steps with a weak prior."""
    center, spread = float(score.mean()), float(score.std()) or 1.0
    z = (score - center) / spread
    x = np.stack((z, np.ones_like(z)), axis=1)
    v = np.zeros(2)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        grad = x.T @ (q - label) + 0.1 * v
        step = np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + 0.1 * np.eye(2), grad)
        v -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return v[0] / spread, v[1] - v[0] * center / spread


class QualityModel:
    def __init__(self, weights: np.ndarray, offset: float, prior: float) -> None:
        self.weights, self.offset, self.prior = weights, offset, prior

    @classmethod
    def fit(cls, positive: list[str], unlabelled: list[str], prior: float | None, negative: list[str] = (), share: float | None = None) -> QualityModel:
        """The scorer learns from ``positive``, ``unlabelled`` and ``prior``.

        If the prior is None it is estimated from both, and is at most ``share``,
        the share of positives among labelled rows, where that is known.
        ``negative`` only helps to find the scale of the scores.
        """
        if not positive or not unlabelled:
            known = share if prior is None else prior
            p = min(max(0.5 if known is None else known, 1e-6), 1 - 1e-6)
            return cls(np.zeros(WIDTH), float(np.log(p / (1 - p))), p)
        p, u = features(positive), features(unlabelled)
        if prior is None:
            prior = estimate_prior(p, u, 0.5 if share is None else share)
            prior = prior if share is None or share >= 1 else min(prior, share)
        w, b = fit_nnpu(p, u, prior)
        del u
        if negative:
            prior_, prior = prior, prior if share is None else share
            # labels as frequent as the whole has them
            keep = min(len(positive) / max(1e-9, prior), len(negative) / max(1e-9, 1 - prior))
            good = p[: max(1, int(keep * prior))] @ w + b
            bad = features(negative[: max(1, int(keep * (1 - prior)))]) @ w + b
            slope, shift = fit_scale(np.concatenate((good, bad)), np.repeat([1.0, 0.0], [len(good), len(bad)]))
            w, b, prior = w * slope, b * slope + shift, prior_
        return cls(w.astype(np.float64), float(b), prior)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1)
        if len(data):
            trigrams, kinds = _ids(data)
            # the first bytes of a row have no left neighbours
            for k, shift in ((0, (0, 1)), (1, (0,))):
                ids = trigrams if k == 0 else kinds
                for s in shift:
                    at = offsets[:-1] + s
                    at = at[at < offsets[1:]]
                    ids[at] = _first_ids(data, at, s, k)
            np.cumsum(self.weights[trigrams] + self.weights[kinds], out=total[1:])
        size = np.maximum(np.diff(offsets), 1)
        g = (total[offsets[1:]] - total[offsets[:-1]]) / size + repeats(data, offsets) @ self.weights[-REPEATS:] + self.offset
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def _first_ids(data: np.ndarray, at: np.ndarray, place: int, kind: int) -> np.ndarray:
    x = data[at].astype(np.uint32)
    if kind == 1:
        return (1 << BITS) + _CLASSES[data[at]]
    one = data[at - 1].astype(np.uint32) if place else np.zeros_like(x)
    return (((x | one << np.uint32(8)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def _score(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = byte_view(batch.column(batch.num_columns - 1))
            score = np.zeros(batch.num_rows)
            for i, j in chunks(off):
                score[i:j] = model.score(data[off[i] : off[j]], off[i : j + 1] - off[i])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], names=[*batch.schema.names[:-1], "score"])

    return tidied(run)


def fit_quality(docs: DataFrame, labels: DataFrame, learn, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, prior: float | None = None) -> QualityModel:
    """Fit on rows where the condition ``learn`` on docs holds. Bound: ``sample`` texts each of positives, unlabelled and labelled rows."""
    rows = docs.where(learn).select(F.col(text).cast("string").alias("t"))
    picked, share = labelled_sample(docs, labels, learn, key, text, label, sample)
    loose = bounded_sample(rows.select("t", F.lit(0).alias("g")), "g", "t", 2 * sample).get(0, [])
    model = QualityModel.fit(picked.get(1, []), loose, prior, picked.get(0, []), share)
    del picked, loose
    release()
    return model


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """``docs`` with a last column ``score`` in 0..1; a column of that name in docs is replaced."""
    bounded_batches(docs.sparkSession)
    rows = docs.drop("score").withColumn(free_name(docs, "_scan"), F.col(text).cast("string"))
    schema = docs.drop("score").schema.add("score", "double")
    return rows.mapInArrow(_score(model), schema)
