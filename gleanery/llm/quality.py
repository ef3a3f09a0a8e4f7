"""A quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled 1; everything else on the web is unlabelled. With the class prior p, the risk of a
scorer over positives and unlabelled texts is p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives)): the second
part estimates the risk on negatives, and holding it at zero from below keeps a flexible scorer from driving it negative.
The scorer, a small network over counts of bytes and of pairs of byte classes, minimises this with the sigmoid loss; a score of
0.5 is where the risk parts the two. Rows labelled 0 are not read.

The prior is estimated from positives and unlabelled texts alone. A linear split of the two, fitted on one half of each, orders
the other half. Of a top bin in that order, the share of unlabelled texts in it over the share of positives in it is at most
the prior, plus the negatives' part; the least such quotient, with a margin for what chance does to small bins, is the estimate.

Fitting takes `sample` positives at most, by a hash of the id; of rows that repeat an id the least features count. The unlabelled
side is all other learning rows, whatever their number: each falls into one of 2 ** `BITS` strata, by the signs of as many random
projections of its features, and a stratum stands in the risk and the prior with the number of its rows, by the features of the row
of least hash. So rare kinds of text have strata of their own, and what is gathered doesn't grow with the table. Rows that repeat an
id, or have none, count there one by one. Scoring covers every whole text. Null text counts as empty and is scored like any other.
Without a positive, or without a learning row, every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm._common import encoded, fold, map_batches

#: Positive documents that fitting takes at most.
SAMPLE = 10_000
#: Signs that name a stratum of unlabelled rows.
BITS = 13


def _classes() -> np.ndarray:
    """Class of each byte: one each for space, line feed, other control bytes, digits, lower and upper case, bytes beyond
    ASCII, common marks, and eight kinds of rarer marks."""
    of = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            of[b] = 6
        elif c.isdigit():
            of[b] = 3
        elif c.islower():
            of[b] = 4
        elif c.isupper():
            of[b] = 5
        elif c == " ":
            of[b] = 0
        elif c == "\n":
            of[b] = 1
        elif b < 32 or b == 127:
            of[b] = 2
        elif c in ".,;:'\"?-":
            of[b] = 7
        else:
            of[b] = 8 + b % 8
    return of


CLASSES = _classes()
WIDTH = 256 + 256 + 8


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of bytes and of pairs of byte classes, and a few measures of words and lines."""
    raw = encoded(text)
    out = np.zeros(WIDTH, np.float32)
    if not raw:
        return out
    data = np.frombuffer(raw, np.uint8)
    out[:256] = np.sqrt(np.bincount(data, minlength=256) / len(data))
    kinds = CLASSES[data]
    if len(data) > 1:
        out[256:512] = np.sqrt(np.bincount(kinds[:-1] * np.uint8(16) + kinds[1:], minlength=256) / (len(data) - 1))
    tokens, lines = raw.split(), raw.split(b"\n")
    n = max(1, len(tokens))
    out[512:] = (
        np.log1p(len(data)) / 10,
        np.log1p(len(tokens)) / 10,
        len(data) / n / 10,
        len(set(tokens)) / n,
        len(set(lines)) / len(lines),
        np.log1p(len(data) / len(lines)) / 10,
        sum(t[-1:] in b"!#$%&*|" for t in tokens) / n,
        float(not tokens),
    )
    return out


class Scorer:
    """One hidden layer over standardised features; margin() is positive where label 1 is likelier."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean.astype(np.float32), scale.astype(np.float32)
        self.weights = [w.astype(np.float32) for w in (rng.normal(0, len(mean) ** -0.5, (len(mean), hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1))]

    def prepared(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def margin(self, z: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(z @ a + b) @ c + d[0]

    def gradient(self, z: np.ndarray, up: np.ndarray) -> list[np.ndarray]:
        """Of the weights, given that of the margin."""
        a, b, c, _ = self.weights
        h = np.tanh(z @ a + b)
        inner = up[:, None] * c * (1 - h * h)
        return [z.T @ inner, inner.sum(0), h.T @ up, np.array([up.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(self.prepared(x)).astype(np.float64))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def risk(scorer: Scorer, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, list[np.ndarray]]:
    """The positives' part of the risk, the estimate of the negatives' part, and the gradient of the step to take: down the
    risk, or where the estimate is below zero, back up that estimate."""
    fp, fu = sigmoid(scorer.margin(p)), sigmoid(scorer.margin(u))
    # sigmoid loss: 1 - s for label 1, s for label 0, where s is the sigmoid of the margin
    slope_p, slope_u = fp * (1 - fp) / len(fp), fu * (1 - fu) / len(fu)
    negatives = float(fu.mean() - prior * fp.mean())
    up_p, up_u = (-2 * prior * slope_p, slope_u) if negatives >= 0 else (prior * slope_p, -slope_u)
    gradient = [x + y for x, y in zip(scorer.gradient(p, up_p.astype(np.float32)), scorer.gradient(u, up_u.astype(np.float32)), strict=True)]
    return float(prior * (1 - fp).mean()), negatives, gradient


def fit(positive: np.ndarray, unlabelled: np.ndarray, weights: np.ndarray | None = None, steps: int = 400, hidden: int = 16, seed: int = 7) -> Scorer | None:
    """By non-negative unbiased risk; an unlabelled row counts by its weight."""
    if not len(positive) or not len(unlabelled):
        return None
    share = _shares(unlabelled, weights)
    everything = np.concatenate([positive, unlabelled]).astype(np.float64)
    of_all = np.concatenate([np.full(len(positive), 0.5 / len(positive)), share / 2])
    mean = of_all @ everything
    scorer = Scorer(mean, np.sqrt(of_all @ (everything - mean) ** 2) + 1e-2, hidden, seed)
    p, u = scorer.prepared(positive), scorer.prepared(unlabelled)
    prior = class_prior(p, u, seed, share)
    first, second = [np.zeros_like(w) for w in scorer.weights], [np.zeros_like(w) for w in scorer.weights]
    rng = np.random.default_rng(seed)
    decay = 1e-4 + 0.5 / len(p)  # few positives are soon learned by heart
    for step in range(1, steps + 1):
        bp, bu = p[rng.integers(0, len(p), 512)], u[rng.choice(len(u), 1024, p=share)]
        for i, (w, g) in enumerate(zip(scorer.weights, risk(scorer, bp, bu, prior)[2], strict=True)):
            g = g + decay * w
            first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
            w -= 0.01 * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return scorer


def _shares(rows: np.ndarray, weights: np.ndarray | None) -> np.ndarray:
    w = np.ones(len(rows)) if weights is None else weights.astype(np.float64)
    return w / max(w.sum(), 1e-300)


def class_prior(p: np.ndarray, u: np.ndarray, seed: int, weights: np.ndarray | None = None) -> float:
    """Share of positives among unlabelled rows, by the best top bin of a split that each half's other half was fitted on."""
    rng = np.random.default_rng(seed)
    share = _shares(u, weights)
    half_p, half_u = rng.permutation(len(p)) % 2, rng.permutation(len(u)) % 2
    scores_p, scores_u = np.zeros(len(p)), np.zeros(len(u))
    for h in (0, 1):
        w, c = _linear_split(p[half_p == h], u[half_u == h], share[half_u == h])
        scores_p[half_p != h], scores_u[half_u != h] = sigmoid(p[half_p != h] @ w + c), sigmoid(u[half_u != h] @ w + c)
    return best_bin(scores_p, scores_u, share)


def best_bin(scores_p: np.ndarray, scores_u: np.ndarray, weights: np.ndarray | None = None) -> float:
    """The least quotient of shares over all top bins, each with what chance may do to it."""
    share = _shares(scores_u, weights)
    at = np.unique(scores_p)
    in_p = 1 - np.searchsorted(np.sort(scores_p), at, "left") / len(scores_p)
    order = np.argsort(scores_u, kind="stable")
    below = np.concatenate([[0.0], np.cumsum(share[order])])
    in_u = np.maximum(0, 1 - below[np.searchsorted(scores_u[order], at, "left")])
    chance = sum(np.sqrt(np.log(40) / (2 * n)) for n in (len(scores_p), 1 / max((share**2).sum(), 1e-300)))
    best = int(np.argmin((in_u + 1.01 * chance) / in_p))
    return float(np.clip(in_u[best] / in_p[best], 0.02, 0.98))


def _linear_split(p: np.ndarray, u: np.ndarray, weights: np.ndarray | None = None, steps: int = 200) -> tuple[np.ndarray, float]:
    """A logistic fit of positives against unlabelled rows, both of the same weight."""
    if not len(p) or not len(u):
        return np.zeros(p.shape[1], np.float32), 0.0
    share = _shares(u, weights).astype(np.float32)
    w, c = np.zeros(p.shape[1], np.float32), 0.0
    for step in range(steps):
        fp, fu = 1 - sigmoid(p @ w + c), sigmoid(u @ w + c) * share
        rate = 0.1 / (1 + step / 50)
        w += rate * (p.T @ fp / len(p) - u.T @ fu - 1e-3 * w).astype(np.float32)
        c += rate * float(fp.mean() - fu.sum())
    return w, c


def _by_hash(df: DataFrame, n: int) -> DataFrame:
    return df.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> Scorer | None:
    """From the rows whose crc32 leaves another remainder than 1 by 3. An id that labels mark 0 and 1 is no positive."""
    learning = docs.select("doc_id", "text").where(~fold(F.col("doc_id"), 3, 1))
    marks = labels.select("doc_id", "quality").where(~fold(F.col("doc_id"), 3, 1)).where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    positive = np.array([np.frombuffer(f, np.float32) for _, f in _positives(learning, _by_hash(marks.where("quality = 1"), sample))], np.float32).reshape(-1, WIDTH)
    if not len(positive):
        return None
    rows = _strata(learning, positive, bits).toLocalIterator()
    got = sorted((r.stratum, r.n, r.f) for r in rows)
    return fit(positive, np.array([np.frombuffer(f, np.float32) for *_, f in got], np.float32).reshape(-1, WIDTH), np.array([n for _, n, _ in got], np.float64))


def _positives(learning: DataFrame, ids: DataFrame) -> list[tuple[int, bytes]]:
    """Ids, which are bounded and so are broadcast, and features."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array([features(t.as_py()).tobytes() for t in rows.column(1)], pa.binary())], ["doc_id", "f"])

    rows = map_batches(learning.join(F.broadcast(ids), "doc_id", "left_semi"), batch, "doc_id long, f binary")
    return sorted((r.doc_id, r.f) for r in rows.groupBy("doc_id").agg(F.min("f").alias("f")).toLocalIterator())


def _strata(learning: DataFrame, positive: np.ndarray, bits: int) -> DataFrame:
    """stratum, n, f: the number of all rows in each stratum and the features of one. Tasks combine theirs before the shuffle."""
    centre, scale = positive.mean(0), positive.std(0) + 1e-2
    planes = np.rint(64 * np.random.default_rng(3).normal(size=(WIDTH, bits)))  # whole numbers: sums are exact in any order
    powers = 1 << np.arange(bits)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        strata, blobs = [], []
        for at in range(0, rows.num_rows, 512):
            x = np.stack([features(t.as_py()) for t in rows.column(1).slice(at, 512)])
            strata.append((np.rint(64 * np.clip((x - centre) / scale, -6, 6)).astype(np.float64) @ planes > 0) @ powers)
            blobs += [f.tobytes() for f in x]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(strata).astype(np.int32)), rows.column(0), pa.array(blobs, pa.binary())], ["stratum", "h", "f"])

    found = map_batches(learning.select(F.xxhash64("doc_id", "text").alias("h"), "text"), batch, "stratum int, h long, f binary")
    return found.groupBy("stratum").agg(F.count("*").alias("n"), F.min(F.struct("h", "f")).alias("x")).select("stratum", "n", "x.f")


def score(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """docs with score, a double, beside its columns doc_id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = rows.column("text").to_pylist()
        if shared.value is None:
            scores = np.full(len(texts), 0.5)
        else:
            scores = np.concatenate([shared.value.score(np.stack([features(t) for t in texts[at : at + 512]])) for at in range(0, len(texts), 512)])
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(scores)], [*rows.schema.names, "score"])

    kinds = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes)
    return map_batches(docs, batch, f"{kinds}, score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, sample)).drop("text")
    return scored.select("doc_id", fold(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """documents without those that the classifier rejects."""
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return score(rows, train(docs, labels, sample)).where("score >= 0.5").drop("score")
