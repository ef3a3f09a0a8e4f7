"""SimHash near-dedup by the similarity of word shingles: one document of each group of near copies.

Two texts are near copies where the sets of their shingles of `width` words have a Jaccard similarity of `SIMILAR` or
more, and a group is what such links connect. Candidates come from two sources:

- links of the texts' SimHash fingerprints within `DISTANCE` bits, by pigeonhole blocks (`gleanery.llm.simhash`);
- min-hashes: `BANDS` keys of `ROWS` minima each, of which a pair of similarity s shares one with a probability of
  1 - (1 - s ** ROWS) ** BANDS, 0.9999 at 0.8.

The second is there because the first can't do it alone: the fingerprints of two texts of similarity 0.8 differ in 9.7 of 64
bits in the mean, and keys that pigeonhole such pairs would hold so few bits that unrelated texts share them.

Texts that candidates connect are compared by their sets of shingles, exactly, from each text to those not yet reached: a
group of n copies costs n comparisons, and one of n texts without links n * n. A candidate group of more than `HELD` shingles, or
`MOST` texts, is cut into parts, and each pair of its parts is a cell of its own, so that none holds more than some 2 * HELD.

Texts of the same shingles, by 128 bits of their set, are first taken as one. A null text counts as empty, and the texts of no words are copies of each
other. Fewer words than `width` are one shingle. Of a group the row of the smallest doc_id stays, one without an id only where
no other has one; between rows of one id in one group the smallest hash of the row. Rows of one id in several groups stay, one
in each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm import simhash
from gleanery.llm._common import checkpointed, encoded, looked_up
from gleanery.llm.components import components, own
from gleanery.llm.substring import Words, mixed, powers_to

BANDS = 24
ROWS = 5
#: Bits in which fingerprints that make candidates differ at most, and the blocks of which half agree then.
DISTANCE = 3
BLOCKS = 6
#: Shingles of a candidate group, or of a part of it, at most; a single text may have more.
HELD = 4_000_000
#: Texts of a part at most, in the mean: a cell compares up to their square.
MOST = 1_024
ROW = "struct<one: long, two: long>"
#: The similarity from which texts are copies, as a fraction.
SIMILAR = (4, 5)
#: Shingles compared, or min-hashed, at a time.
RUN = 1 << 18
#: Rows of an Arrow batch that are held as Python objects at a time.
SLICE = 256
CHARACTERS = 1_000_000

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(20).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.array([[0], [1]], np.uint64)


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """Of each text the sorted hashes of its shingles without repeats; A-Z in lower case."""
    words = Words([encoded(t).lower() for t in texts])
    n = len(words)
    power, inverse = powers_to(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hashes() * power[:n])])
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        size = min(width, b - a)
        if not size:
            out.append(np.zeros(0, np.uint64))
            continue
        at = np.arange(a, b - size + 1)
        out.append(np.unique(mixed((sums[at + size] - sums[at]) * inverse[at] + np.uint64(size))))
    return out


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    return shingle_sets([text], width)[0]


def name_of(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a set of shingles."""
    return xxhash.xxh3_128_digest(hashes.tobytes(), 7)


def band_keys(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Of each set a long for each band; none for no shingles. Sets are taken together, RUN shingles or one set at a time."""
    out = [np.zeros(0, np.int64)] * len(sets)
    filled = [i for i, s in enumerate(sets) if len(s)]
    ends = np.cumsum([len(sets[i]) for i in filled])
    at = 0
    while at < len(filled):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN, "right")))
        some = filled[at:upto]
        flat = np.concatenate([sets[i] for i in some])
        starts = np.cumsum([0, *(len(sets[i]) for i in some[:-1])])
        key = np.zeros((len(some), BANDS), np.uint64)
        for j, (salt, factor) in enumerate(_SEEDS.T):
            least = np.minimum.reduceat((flat ^ salt) * factor, starts)
            key[:, j // ROWS] = mixed(key[:, j // ROWS] * _FACTOR + least)
        key = mixed(key + np.arange(BANDS, dtype=np.uint64) * _FACTOR)  # bands apart
        for i, k in zip(some, key.view(np.int64), strict=True):
            out[i] = k
        at = upto
    return out


def links_within(names: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what all pairs of similarity SIMILAR or more connect."""
    part, whole = SIMILAR
    sizes = np.array([len(s) for s in sets])
    out, left = [], np.arange(len(sets))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            mine, near = sets[x], np.zeros(len(left), bool)
            fits = np.flatnonzero((whole * sizes[left] >= part * len(mine)) & (whole * len(mine) >= part * sizes[left]))
            ends = np.cumsum(sizes[left[fits]])
            at = 0
            while at < len(fits):
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN, "right")))
                some = fits[at:upto]
                flat = np.concatenate([sets[j] for j in left[some]])
                hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                starts = np.concatenate([[0], np.cumsum(sizes[left[some]])[:-1]])
                common = np.add.reduceat(hit.astype(np.int64), starts)
                near[some] = whole * common >= part * (len(mine) + sizes[left[some]] - common)
                at = upto
            queue.extend(left[near])
            out += [(names[x], names[j]) for j in left[near]]
            left = left[~near]
    return out


def _row() -> Column:
    """128 bits of a whole row, as two longs."""
    columns = [x for c in ("doc_id", "text", "lang", "source", "n_chars") for x in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.xxhash64(*columns).alias("one"), F.xxhash64(F.lit("another"), *columns).alias("two"))


def _sliced(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: int = 2) -> DataFrame:
    """mapInArrow over slices of each batch, of SLICE rows and about CHARACTERS bytes of text at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                upto = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHARACTERS, "right"))
                upto = max(at + 1, min(upto, at + SLICE))
                yield function(batch.slice(at, upto - at))
                at = upto

    return df.mapInArrow(run, schema)


def fingerprint_of(hashes: np.ndarray) -> int:
    """SimHash of a set of shingles, as a long."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), RUN):
        ones += np.unpackbits(hashes[at : at + RUN].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _leasts(k: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of k and name: where each k begins, and the least name of every row's k."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1])
    return starts, name[starts], np.repeat(name[starts], np.diff(np.concatenate([starts, [len(k)]])))


def _stars(rows: DataFrame) -> DataFrame:
    """node, keys: a, b from nodes to the least of each key. Tasks combine what they hold of a key before it is shuffled: of a
    hot key each sends its least name, and links that are found go along under a key of their own."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            k, name = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort([name, k])
            k, name = k[order], name[order]
            starts, first, centre = _leasts(k, name)
            apart = centre != name
            pairs = np.unique(np.stack([name[apart], centre[apart]], axis=1), axis=0)
            columns = np.concatenate([k[starts], pairs[:, 0]]), np.concatenate([first, pairs[:, 0]]), np.concatenate([first, pairs[:, 1]])
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.arange(len(columns[0])) >= len(starts))], ["k", "a", "b", "found"])

        for part in batches:
            keys = part.column(1)
            held.append((keys.flatten().to_numpy(), np.repeat(part.column(0).to_numpy(zero_copy_only=False), keys.value_lengths().to_numpy(zero_copy_only=False))))
            size += len(held[-1][0])
            if size >= 2_000_000:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_k, last = None, 0
        for part in batches:
            k, a, b, found = (part.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            ends = [(a[found], b[found])]
            k, a = k[~found], a[~found]
            if len(k):
                _, first, centre = _leasts(k, a)
                if k[0] == last_k:  # went on from the batch before, whose least is less
                    centre[k == last_k] = first[0] = last
                last_k, last = k[-1], first[-1]
                ends.append((a, centre))
            a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    combined = rows.select("node", "keys").mapInArrow(combine, "k long, a long, b long, found boolean")
    return combined.repartition("k").sortWithinPartitions("found", "k", "a").mapInArrow(meet, "a long, b long")


def _links(sets: DataFrame) -> DataFrame:
    """cell, node, shingles: a, b, the links of each cell. Rows of a cell are together."""

    def found(names: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.array(links_within(names, held), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, names, held = None, [], []
        for rows in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            for c, name, s in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
                if c != cell:
                    if len(names) > 1:
                        yield found(names, held)
                    cell, names, held = c, [], []
                if not names or names[-1] != name:
                    names.append(name)
                    held.append(np.frombuffer(s, np.uint64))
        if len(names) > 1:
            yield found(names, held)

    return sets.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, width: int = 5, held: int = HELD, most: int = MOST) -> DataFrame:
    """doc_id, row (a hash of the whole row), component for every row of documents."""
    docs = docs.withColumn("row", _row())

    def signed(rows: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(rows.column(2).to_pylist(), width)
        numbers = [fingerprint_of(s) for s in sets], list(map(len, sets))
        keys = pa.array(band_keys(sets), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), rows.column(1), pa.array(list(map(name_of, sets)), pa.binary()), *(pa.array(v, pa.int64()) for v in numbers), keys], ["doc_id", "row", "name", "fp", "n", "keys"])

    def with_set(rows: pa.RecordBatch) -> pa.RecordBatch:
        sets = pa.array([x.tobytes() for x in shingle_sets(rows.column(2).to_pylist(), width)], pa.binary())
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), sets, *rows.columns[3:]], ["root", "node", "shingles", *rows.schema.names[3:]])

    rows = checkpointed(_sliced(docs.select("doc_id", "row", "text"), signed, f"doc_id long, row {ROW}, name binary, fp long, n long, keys array<long>"))
    # one row for each set, with a number of its own: what follows links these numbers
    firsts = rows.groupBy("name").agg(F.min(F.struct("row", "fp", "n", "keys")).alias("x"), F.count("*").alias("copies")).select("name", "copies", "x.*")
    firsts = checkpointed(firsts.withColumn("node", F.monotonically_increasing_id()))
    near = simhash.links(firsts.where("n > 0").select("fp", "node"), DISTANCE, BLOCKS)
    found = components(_stars(firsts).union(near))
    candidates = checkpointed(found.join(firsts.select(F.col("node").alias("own"), "row", "n"), F.col("node") == F.col("own")).select("root", "node", "row", "n"))
    # each group in as many parts as its shingles or its texts take, each pair of parts a cell
    parts = candidates.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / held), F.ceil(F.count("*") / most)).cast("int").alias("parts"))
    parts = parts.select(own(F.col("root")).alias("w"), "parts")
    dealt = candidates.join(parts.hint("shuffle_merge"), F.col("root") == F.col("w")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.xxhash64("root", F.least("part", other), F.greatest("part", other)))
    # of rows that are alike in every column one brings the text
    texts = docs.select("row", "text").join(dealt.select("root", "node", "row", cells.alias("cells")), "row").dropDuplicates(["row"]).select("root", "node", "text", "cells")
    sets = _sliced(texts, with_set, "root long, node long, shingles binary, cells array<long>")
    linked = components(_links(sets.select(F.explode("cells").alias("cell"), "node", "shingles")))
    named = firsts.select("name", "node", "copies").join(linked.withColumnRenamed("node", "own"), F.col("node") == F.col("own"), "left")
    named = checkpointed(named.select("name", F.coalesce("root", "node").alias("component"), "copies"))
    # copies by the thousand share a name: a hot key, looked up by broadcast
    return looked_up(rows.select("doc_id", "row", "name"), named, ["name"], "copies").select("doc_id", "row", "component")


def representatives(df: DataFrame, width: int = 5) -> DataFrame:
    """documents with one row of each group."""
    docs = df.select("doc_id", "text", "lang", "source", "n_chars")
    first = groups(docs, width).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("x")).select("x.row")
    return docs.withColumn("row", _row()).join(checkpointed(first), "row", "left_semi").dropDuplicates(["row"]).drop("row")
