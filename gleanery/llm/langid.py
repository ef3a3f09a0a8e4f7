"""Language identification by a byte convolutional network, trained in numpy.

A text is cut into windows of `WINDOW` bytes. Bytes are embedded, filters of several widths slide over the window, each
filter's greatest response is pooled, and a softmax over the pooled responses gives each language's probability. A text's
probabilities are the mean over all of its windows.

Training takes a bounded sample of documents with a letter: `per_language` ids of each language, by a hash of the id, fewer where
there are so many languages that these would be more than `sample` ids, but one at least, however often its rows repeat it; and of
each `per_document` windows, spread evenly. Of rows that repeat an id and a language the windows that come first in order are taken.
Prediction covers every byte of every text. A text that is null or has no letter is `und`, with score 0, as is every text where
nothing was learned.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.llm._common import encoded, fold, map_batches

WINDOW = 96
EMBEDDING = 8
WIDTHS = (2, 3, 4)
FILTERS = 12
#: Windows that go through the network at a time; their activations fit a core's cache.
RUN = 64
_LETTER = re.compile(r"[^\W\d_]")


def windows(text: str) -> np.ndarray:
    """All windows of a text; the last is filled up with zeros."""
    raw = encoded(text)
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def has_letter(text: str) -> bool:
    """Whether a text has a letter; numerals that patterns take for letters are none."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


class Network:
    def __init__(self, languages: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages, widest, n = languages, max(WIDTHS), len(WIDTHS) * FILTERS
        # filters of all widths as one matrix; a narrow filter's further rows stay zero
        self.mask = np.zeros((widest * EMBEDDING, n), np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[: w * EMBEDDING, i * FILTERS : (i + 1) * FILTERS] = 1
        self.embedding = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.filters = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.2, (n, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def _columns(self, x: np.ndarray) -> np.ndarray:
        """For each place of each window, the embeddings under the widest filter."""
        widest = max(WIDTHS)
        e = self.embedding[np.pad(x, ((0, 0), (0, widest - 1)))]
        n, length = x.shape
        view = np.lib.stride_tricks.as_strided(e, (n, length, widest * EMBEDDING), e.strides)
        return view.reshape(n * length, widest * EMBEDDING)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        columns = self._columns(x)
        a = (columns @ self.filters).reshape(len(x), x.shape[1], -1)
        return a.max(axis=1) + self.bias, a, columns

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.languages)), np.float32)
        for at in range(0, len(x), RUN):
            h = np.maximum(self.pooled(x[at : at + RUN])[0], 0)
            z = h @ self.out + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[at : at + RUN] = z / z.sum(axis=1, keepdims=True)
        return out

    def learn(self, x: np.ndarray, y: np.ndarray, epochs: int = 3, rate: float = 0.01, seed: int = 5) -> None:
        """Adam on the cross-entropy."""
        rng = np.random.default_rng(seed)
        weights = [self.embedding, self.filters, self.bias, self.out, self.out_bias]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 64):
                rows = order[at : at + 64]
                step += 1
                for w, g, m, v in zip(weights, self._gradients(x[rows], y[rows]), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        pooled, a, columns = self.pooled(x)
        h = np.maximum(pooled, 0)
        z = h @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        up = z / z.sum(axis=1, keepdims=True)
        up[np.arange(len(y)), y] -= 1
        up /= len(y)
        g_h = (up @ self.out.T) * (pooled > 0)
        where = a.argmax(axis=1)  # windows x filters
        n, k = where.shape
        picked = columns[(np.arange(n)[:, None] * x.shape[1] + where).reshape(-1)].reshape(n, k, -1)
        g_filters = np.einsum("nk,nkc->ck", g_h, picked) * self.mask
        g_columns = (g_h[:, :, None] * self.filters.T[None]).reshape(n * k, max(WIDTHS), EMBEDDING)
        g_embedding = np.zeros_like(self.embedding)
        padded = np.pad(x, ((0, 0), (0, max(WIDTHS) - 1)))
        for o in range(max(WIDTHS)):
            np.add.at(g_embedding, padded[np.arange(n)[:, None], where + o].reshape(-1), g_columns[:, o])
        return [g_embedding, g_filters, g_h.sum(0), h.T @ up, up.sum(0)]


def predict(network: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if network is not None and t and has_letter(t)]
    for at in range(0, len(known), 64):
        part = known[at : at + 64]
        cut = [windows(texts[i]) for i in part]
        p = network.probabilities(np.concatenate(cut))
        starts = np.cumsum([0, *map(len, cut[:-1])])
        mean = np.add.reduceat(p.astype(np.float64), starts, axis=0) / np.array(list(map(len, cut)))[:, None]
        for i, row in zip(part, mean, strict=True):
            best = int(row.argmax())
            names[i], scores[i] = network.languages[best], float(min(1.0, row[best]))
    return names, scores


def sampled(learning: DataFrame, per_language: int, sample: int) -> DataFrame:
    """lang, doc_id: those of the least hashes of each language. Only the least of all, and ids whose hash is below a bound by the
    language's number of ids, are ranked: some sixteen times as many as are wanted, so that a ranking doesn't grow with the table."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    counts = learning.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids"), F.min(F.struct(place, "doc_id")).getField("doc_id").alias("least"))
    languages = learning.select("lang").distinct().count()
    n = max(1, min(per_language, sample // max(1, languages)))
    held = F.broadcast(counts) if languages <= sample else counts
    near = (place.cast("double") * F.col("ids") <= float(16 * n << 40)) | (F.col("doc_id") == F.col("least"))
    few = learning.select("lang", "doc_id").join(held, "lang").where(near).select("lang", "doc_id").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id"))
    return few.withColumn("n", rank).where(F.col("n") <= n).select("lang", "doc_id")


def train(docs: DataFrame, per_language: int = 500, per_document: int = 8, sample: int = 20_000) -> Network | None:
    """From text and lang of the rows whose crc32 leaves another remainder than 0 by 5."""
    learning = docs.select("doc_id", "lang", "text").where(~fold(F.col("doc_id"), 5, 0)).where("lang is not null and doc_id is not null").where(F.col("text").rlike(r"\p{L}"))
    ids = sampled(learning, per_language, sample)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [])
        for key, lang, text in zip(*rows.columns, strict=True):
            if has_letter(text.as_py()):
                cut = windows(text.as_py())
                chosen = sorted(set(np.linspace(0, len(cut) - 1, per_document).astype(int).tolist()))
                for column, value in zip(out, (key.as_py(), lang.as_py(), cut[chosen].tobytes()), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.string(), pa.binary()), strict=True)], ["doc_id", "lang", "w"])

    # the ids are bounded by the sample unless there are more languages than that, when they aren't broadcast by order
    bounded = F.broadcast(ids) if ids.count() <= sample else ids
    found = map_batches(learning.join(bounded, ["doc_id", "lang"]).select("doc_id", "lang", "text"), batch, "doc_id long, lang string, w binary")
    rows = sorted((r.lang, r.doc_id, r.w) for r in found.groupBy("lang", "doc_id").agg(F.min("w").alias("w")).toLocalIterator())
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    network = Network(languages)
    each = [np.frombuffer(r[2], np.uint8).reshape(-1, WINDOW) for r in rows]
    network.learn(np.concatenate(each), np.repeat([languages.index(r[0]) for r in rows], list(map(len, each))))
    return network


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = predict(shared.value, rows.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    found = map_batches(docs.select("doc_id", "text"), batch, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", fold(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")
