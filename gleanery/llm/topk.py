"""Exact top-k search by distributed histogram selection.

Vectors are scaled to integers, so that scores are exact. Queries go in waves of about `block` rows; for each wave every row
is scored once, and each task writes its own k best of each query, by (score, id), to the shared folder: the global k best are
among them. From these lists score histograms are counted in global bins and summed, and the bin that holds a query's k-th
score becomes its next range, until a bin is one value wide: that value is the query's k-th score. What reaches it is ranked,
with ties to the smaller id.

Only histograms and the last rows are shuffled: k bins of each task and query at most, whatever scores repeat. A wave's
queries and three numbers for each are all that the driver holds.

A vector that is null, or holds a null or a component that isn't finite (scaled, as a double), takes no part, nor does a null
id. Vectors of another length than a query's are no candidates of it. Rows with the query's own id aren't either; of rows that
repeat a query's id the least vector asks. Scores are longs: sums wrap at 64 bits, and where a sum could be beyond them it is
checked by its size as a double, or with integers of any size. A score above the greatest long raises OverflowError, and so
does one below the least that is among a query's k best.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.llm._common import checkpointed

BIN_BITS = 11
BINS = 1 << BIN_BITS
#: Scores held at a time.
CELLS = 1 << 21
LEAST = np.iinfo(np.int64).min


def scaled(ids: pa.Array, vectors: pa.Array, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids, and floor(scale * x) as float64, of the rows that take part."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(over="ignore"):
        flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    row = np.repeat(np.arange(len(lengths)), lengths)
    good = ~vectors.is_null().to_numpy(zero_copy_only=False) & ~ids.is_null().to_numpy(zero_copy_only=False)
    good[row[~np.isfinite(flat)]] = False
    keys = ids.fill_null(0).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    out = {}
    for n in np.unique(lengths[good]):
        rows = np.flatnonzero(good & (lengths == n))
        out[int(n)] = keys[rows], flat[starts[rows][:, None] + np.arange(n)].reshape(len(rows), n)
    return out


def wrapped(values: np.ndarray) -> np.ndarray:
    """Whole float64 numbers of any size modulo 2 ** 64, as int64."""
    low = np.fmod(values, 2.0**64)  # exact
    low = np.where(low < -(2.0**63), low + 2.0**64, np.where(low >= 2.0**63, low - 2.0**64, low))
    return low.astype(np.int64)


def _norms(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((values * values).sum(axis=1))


class Wave:
    """Queries of one length."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray):
        self.ids, self.queries, self.norms = ids, queries, _norms(queries)

    def scores(self, keys: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, scores (queries by rows), and which are another row's than the query's own. A score below the least long is
        held as the least."""
        step = max(1, CELLS // max(1, len(self.ids)))
        heavy = _norms(vectors) * self.norms.max(initial=0) >= 2.0**52
        for rows in (np.flatnonzero(~heavy), np.flatnonzero(heavy)):
            for at in range(0, len(rows), step):
                part, k = vectors[rows[at : at + step]], keys[rows[at : at + step]]
                other = self.ids[:, None] != k[None, :]
                yield k, self._long(part, other) if heavy[rows[0]] else (self.queries @ part.T).astype(np.int64), other

    def _long(self, part: np.ndarray, other: np.ndarray) -> np.ndarray:
        s = wrapped(self.queries) @ wrapped(part).T
        with np.errstate(over="ignore", invalid="ignore"):
            about = self.queries @ part.T
            doubt = np.outer(self.norms, _norms(part)) * (2.0**-52 * (part.shape[1] + 1))
            unsure = other & ~(np.abs(about) + doubt < 2.0**63)
        for i, j in zip(*np.nonzero(unsure), strict=True):
            whole = sum(int(a) * int(b) for a, b in zip(self.queries[i], part[j], strict=True))
            if whole >= 1 << 63:
                raise OverflowError("a score doesn't fit a long")
            s[i, j] = max(whole, LEAST)
        return s


def search(df: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, block: int = 16_384, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k rows of highest integer inner product, all if fewer."""
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v"), is_query.alias("q"))
    finite = F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(F.abs(x.cast("double")) * F.lit(float(scale)) < float("inf"), F.lit(False)))
    asking = rows.where("q and vec_id is not null").where(finite)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(F.abs(x.cast("double")) * F.lit(float(scale)) + F.lit(1.0), F.lit(2.0))))
    facts = rows.agg(F.max(F.when(finite, norm)).alias("norm"), F.approx_count_distinct(F.when(F.col("q") & finite, F.col("vec_id"))).alias("n")).first()
    parts = max(1, -(-facts.n // block))
    found = []
    for part in range(parts):
        asked = asking.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).groupBy("vec_id").agg(F.min("v").alias("v"))
        by_length: dict[int, list] = {}
        for batch in asked.toArrow().to_batches():
            for n, (ids, vectors) in scaled(batch.column(0), batch.column(1), scale).items():
                by_length.setdefault(n, []).append((ids, vectors))
        for n, got in sorted(by_length.items()):
            wave = Wave(*map(np.concatenate, zip(*got, strict=True)))
            found.append(_selected(_bests(rows.select("vec_id", "v"), n, wave, k, scale), wave, facts.norm, k))
    empty = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.union, found) if found else empty


def _bests(rows: DataFrame, length: int, wave: Wave, k: int, scale: int) -> DataFrame:
    """Each task's k best of each query: q (the query's place in the wave), vec_id, score."""
    shared = rows.sparkSession.sparkContext.broadcast(wave)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Wave = shared.value
        n = len(w.ids)
        q = keys = scores = np.zeros(0, np.int64)
        last_score, last_key = np.full(n, LEAST), np.full(n, np.iinfo(np.int64).max)  # of each query's k-th, or none yet
        for batch in batches:
            if not batch.num_rows or not (got := scaled(batch.column(0), batch.column(1), scale).get(length)):
                continue
            for ids, s, other in w.scores(*got):
                better = other & ((s > last_score[:, None]) | ((s == last_score[:, None]) & (ids[None, :] <= last_key[:, None])))
                at, row = np.nonzero(better)
                q, keys, scores = np.concatenate([q, at]), np.concatenate([keys, ids[row]]), np.concatenate([scores, s[at, row]])
                order = np.lexsort([keys, ~scores, q])
                q, keys, scores = q[order], keys[order], scores[order]
                place = np.arange(len(q)) - np.searchsorted(q, q, "left")
                q, keys, scores, place = (x[place < k] for x in (q, keys, scores, place))
                full = place == k - 1
                last_score[q[full]], last_key[q[full]] = scores[full], keys[full]
        for at in range(0, len(q), 65_536):
            part = slice(at, at + 65_536)
            yield pa.RecordBatch.from_arrays([pa.array(q[part].astype(np.int32)), pa.array(keys[part]), pa.array(scores[part])], ["q", "vec_id", "score"])

    return checkpointed(rows.mapInArrow(best, "q int, vec_id long, score long"))


def _kth_bins(bests: DataFrame, ranges: Broadcast, k: int) -> DataFrame:
    """q, bin, above: for each query the bin of its range that holds its k-th score, and how many scores are beyond it. A
    range has `span` bins, BINS but in the last step; what lies above it has been counted."""

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, _, shift, span = ranges.value
        counts: dict[int, int] = {}
        for batch in batches:
            q, s = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            bins = (s.view(np.uint64) - low[q].view(np.uint64)) >> np.uint64(shift)
            take = (s >= low[q]) & (bins < span)
            for key, n in zip(*np.unique(q[take].astype(np.int64) * BINS + bins[take].astype(np.int64), return_counts=True), strict=True):
                counts[int(key)] = counts.get(int(key), 0) + int(n)
        keys = np.fromiter(counts, np.int64, len(counts))
        yield pa.RecordBatch.from_arrays([pa.array((keys // BINS).astype(np.int32)), pa.array((keys % BINS).astype(np.int32)), pa.array(list(counts.values()), pa.int64())], ["q", "bin", "n"])

    def kth(rows: pa.Table) -> pa.Table:
        q = rows.column("q")[0].as_py()
        had = int(ranges.value[1][q])
        bins, n = (rows.column(c).to_numpy() for c in ("bin", "n"))
        order = np.argsort(-bins)
        total = had + np.cumsum(n[order])
        at = int(np.searchsorted(total, k))
        out = (int(bins[order[at]]), int(total[at] - n[order[at]])) if at < len(order) else (0, had)
        return pa.table({"q": pa.array([q], pa.int32()), "bin": pa.array([out[0]], pa.int32()), "above": pa.array([out[1]], pa.int64())})

    counted = bests.mapInArrow(histograms, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
    return counted.groupBy("q").applyInArrow(kth, "q int, bin int, above long")


def _selected(bests: DataFrame, wave: Wave, norm: float, k: int) -> DataFrame:
    """Refines each query's range until its k-th score is found, and ranks what reaches it."""
    context = bests.sparkSession.sparkContext
    with np.errstate(over="ignore"):
        bound = np.minimum(_norms(wave.queries) * norm * (1 + 2.0**-20) + 1, 2.0**63)
    # where a range of scores begins; offsets from there are unsigned, so that the whole of a long's range fits
    low = np.array([max(-int(b), int(LEAST)) for b in bound], np.int64)
    bits = (2 * int(bound.max()) + 1).bit_length()
    above, shift = np.zeros(len(low), np.int64), min(bits, 64)
    while shift:
        was, shift = shift, max(0, shift - BIN_BITS)
        for r in _kth_bins(bests, context.broadcast((low.copy(), above.copy(), shift, 1 << (was - shift))), k).toLocalIterator():
            low[r.q] = np.int64(int(low[r.q]) + (r.bin << shift))
            above[r.q] = r.above
    reached = context.broadcast(low)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, s = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            take = np.flatnonzero(s >= reached.value[q])
            if (s[take] == LEAST).any():
                raise OverflowError("a score doesn't fit a long")
            yield pa.RecordBatch.from_arrays([pa.array(wave.ids[q[take]]), batch.column(1).take(pa.array(take)), pa.array(s[take])], ["query_id", "vec_id", "score"])

    kept = bests.mapInArrow(keep, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return kept.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The query over `embeddings`, in DuckDB's SQL.
ORACLE = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM vectors q JOIN vectors c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""
