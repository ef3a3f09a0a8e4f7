"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents fall, by a hash of source and id, into `BLOCKS` blocks: a random permutation, cut into blocks. A
source whose target is e times its size and a rest gives each block e times, and of one more epoch the first blocks of
the permutation that make up the rest. So each source has an exact quota of blocks; the block where the rest ends is
opened, and its documents are taken in the order of the permutation while they fit whole. What is left, less than the first
document that doesn't fit, is filled from the documents after it: by the longest that fit, again and again, and at last by one
that is too long by less than what is left. Which ones of a size are taken the permutation decides. So a gap is never larger
than half of any document that could have filled it.

The tree deals the quotas to output shards: a node with so many blocks of each source splits them between its halves by
a multivariate hypergeometric draw, down to single shards, whose quotas add up exactly. Shards then own disjoint runs of
each source's sequence of blocks, and shuffle within themselves. Draws are seeded by the node, so that reruns agree.

What travels is the plan, a few numbers for each source: workers draw the tree's nodes anew from its seed, those above the blocks they
have, and keep some. The driver holds the plan, the sums of the blocks of `AT_ONCE` sources, and the sizes that differ, of as many
sources at a time as have `KINDS` of them, or of one. The opened block is found
level by level by its documents' hashes, each level an aggregation to BLOCKS sums for each source, so that neither a hot
source nor a long one lands in one task. A block of BLOCKS documents at most is opened at once.

A null source is a source, the last in order. Null text has size 0. A document's place in the permutation comes from its
source, id and text: rows that agree in all of them are taken together, as one of their common size, and rows without an id
are apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.llm._common import checkpointed, encoded, map_batches

BITS = 10
BLOCKS = 1 << BITS
LEVELS = 5
WEIGHTS = (5, 2, 1)
#: Times that a source, and so a document, is taken at most.
MOST = 3
#: Sources whose blocks' sums are gathered at a time.
AT_ONCE = 2_000
KINDS = 1_000_000
#: Nodes of the tree that a worker keeps, in numbers.
KEPT = 4_000_000
#: Output shards, at least, and the words that each holds from there on.
SHARDS = 64
SHARD_WORDS = 20_000_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[Fraction]:
    """Shares of all sizes by weight; who would be above `most` times its size stops there, and the excess goes to the
    others by weight, until none is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [Fraction(0)] * len(sizes)
    free, left = set(range(len(sizes))), Fraction(sum(sizes))
    while free:
        total = sum(w[i] for i in free)
        over = [i for i in free if left * w[i] > most * sizes[i] * total]
        if not over:
            for i in free:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = Fraction(most * sizes[i])
            left -= most * sizes[i]
            free.discard(i)
    return out


@dataclass
class Fill:
    """Documents beyond the border that are taken once more: of a size, up to a hash; and by their hashes. The latter are for
    sizes of which some rows share a place; they hold no more words than the longest document."""

    ends: dict[int, int]
    places: frozenset[int]


@dataclass
class Plan:
    """For each source: whole epochs, the hash below which documents are taken once more, what fills it up, and its quota of blocks,
    which the tree deals to the shards."""

    sources: list[str | None]
    sizes: list[int]
    targets: list[float]
    epochs: list[int]
    below: list[int]
    fills: list[Fill]
    quotas: list[int]
    n_shards: int
    seed: int

    def __post_init__(self) -> None:
        self.tree = Tree(self.quotas, self.n_shards, self.seed)

    def needs_size(self, i: int, h: int) -> bool:
        return h >= self.below[i] and bool(self.fills[i].ends)

    def shards(self, i: int, h: int, size: int) -> list[int]:
        """Where each copy of a document of source i lies."""
        fill = self.fills[i]
        copies = self.epochs[i] + (h < self.below[i] or h < fill.ends.get(size, 0) or h in fill.places)
        last = self.quotas[i] - 1  # a filling document goes with the last block
        return [self.tree.shard(i, min(last, e * BLOCKS + (h >> (BITS * (LEVELS - 1))))) if last >= 0 else 0 for e in range(copies)]


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("source").isNull(), "source", F.col("doc_id").isNull(), "doc_id", "text")


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size, h: a permutation's place of every row, from 0 up to 2 ** 50."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        sizes = [len(encoded(t.as_py()).split()) for t in rows.column(2)]
        return pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), rows.column(1).cast(pa.string()), pa.array(sizes, pa.int64()), rows.column(3)], ["doc_id", "source", "size", "h"])

    return map_batches(docs.select("doc_id", "source", "text", _place(seed)), batch, "doc_id long, source string, size long, h long")


def _place(seed: int) -> Column:
    return F.shiftrightunsigned(_hash(seed), 64 - BITS * LEVELS).alias("h")


def plan(rows: DataFrame, shards: int | None, seed: int) -> Plan:
    """From sized() rows."""
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8")))
    sources, sizes = [r.source for r in found], [r["size"] for r in found]
    shards = shards or max(SHARDS, -(-sum(sizes) // SHARD_WORDS))
    wanted = targets(sizes)
    epochs = [int(t // s) if s else 0 for t, s in zip(wanted, sizes, strict=True)]
    rest = {i: wanted[i] - epochs[i] * sizes[i] for i in range(len(sources)) if sizes[i] and wanted[i] > epochs[i] * sizes[i]}
    ends = _border(rows, sources, rest)
    below = [ends.get(i, 0) for i in range(len(sources))]
    fills = _fills(rows, sources, rest, below)
    quotas = [e * BLOCKS + (b >> (BITS * (LEVELS - 1))) + (b & ((1 << (BITS * (LEVELS - 1))) - 1) > 0) for e, b in zip(epochs, below, strict=True)]
    return Plan(sources, sizes, [float(t) for t in wanted], epochs, below, fills, quotas, shards, seed)


def _border(rows: DataFrame, sources: list[str | None], rest: dict[int, Fraction]) -> dict[int, int]:
    """For each source with rows among these, the hash of the first document that is too much for its rest, or one above
    all. What lies before is taken off its rest."""
    out: dict[int, int] = {}
    if len(rest) > AT_ONCE:
        for at in range(0, len(rest), AT_ONCE):
            some = {i: rest[i] for i in list(rest)[at : at + AT_ONCE]}
            out |= _border(rows, sources, some)
            rest |= some
        return out
    place = {s: i for i, s in enumerate(sources)}
    at = {i: (0, 0) for i in rest}  # level and path of the block that is open
    level_of = {i: 1 for i in rest}
    while level_of:
        within = None
        for level in sorted(set(level_of.values())):
            for above in sorted({at[i][0] for i, n in level_of.items() if n == level}):
                some = {i: at[i][1] for i, n in level_of.items() if n == level and at[i][0] == above}
                shift = BITS * (LEVELS - level)
                held = F.broadcast(_frame(rows, "s string, path long", [(sources[i], p) for i, p in some.items()]))
                part = rows.join(held, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", BITS * (LEVELS - above)) == F.col("path")), "left_semi")
                part = part.groupBy("source", F.shiftright("h", shift).alias("path")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
                within = part if within is None else within.union(part)
        sums: dict[int, dict[int, tuple[int, int]]] = {}
        for r in within.toLocalIterator():
            sums.setdefault(place[r.source], {})[r.path] = (r["size"], r.n)
        for i, level in list(level_of.items()):
            border = None
            for path in sorted(sums.get(i, {})):
                size, n = sums[i][path]
                if size > rest[i] or (size == rest[i] and level < LEVELS):
                    border = path
                    break
                rest[i] -= size
            if border is not None and level < LEVELS:
                at[i], level_of[i] = (level, border), LEVELS if n <= BLOCKS else level + 1
                continue
            if border is not None:
                out[i] = border
            elif i in sums:
                out[i] = (max(sums[i]) + 1) << (BITS * (LEVELS - level))
            del level_of[i]
    return out


def _fills(rows: DataFrame, sources: list[str | None], rest: dict[int, Fraction], below: list[int]) -> list[Fill]:
    """What brings each source nearer to its target, from the border on."""
    out = [Fill({}, frozenset()) for _ in sources]
    open_ = [i for i, r in rest.items() if r > 0]
    for at in range(0, len(open_), AT_ONCE):
        some = {i: rest[i] for i in open_[at : at + AT_ONCE]}
        wanted = _frame(rows, "t string, i int, start long, most double", [(sources[i], i, below[i], float(2 * r)) for i, r in some.items()])
        unused = rows.join(F.broadcast(wanted), F.col("source").eqNullSafe(F.col("t"))).where((F.col("h") >= F.col("start")) & (F.col("size") > 0) & (F.col("size") < F.col("most")))
        # rows that share a place are a unit of so many times their size
        units = checkpointed(unused.groupBy("i", "size", "h").count().withColumnRenamed("count", "m"))
        differ = {r.i: r.n for r in units.groupBy("i").agg(F.approx_count_distinct(F.struct("size", "m")).alias("n")).toLocalIterator()}
        part: list[int] = []
        for i in [*differ, None]:
            if part and (i is None or sum(differ[j] for j in part) + differ[i] > KINDS):
                held = _frame(rows, "j int", [(j,) for j in part])
                for j, fill in _filled(units.join(F.broadcast(held), F.col("i") == F.col("j"), "left_semi"), {j: rest[j] for j in part}).items():
                    out[j] = fill
                part = []
            part += [i] if i is not None else []
    return out


def _filled(units: DataFrame, rest: dict[int, Fraction]) -> dict[int, Fill]:
    rows = units
    kinds: dict[int, dict[tuple[int, int], int]] = {}
    for r in units.groupBy("i", "size", "m").count().toLocalIterator():
        kinds.setdefault(r.i, {})[r["size"], r.m] = r["count"]
    # the longest units that fit first, then one that is too long by less than what is left
    chosen: dict[tuple[int, int, int], int] = {}
    for i, counts in kinds.items():
        left = rest[i]
        words = {k: k[0] * k[1] for k in counts}
        for k in sorted(counts, key=lambda k: (-words[k], k)):
            if n := min(counts[k], int(left // words[k])):
                chosen[i, *k] = n
                left -= n * words[k]
        over = min((k for k, n in counts.items() if left < words[k] < 2 * left and n > chosen.get((i, *k), 0)), key=lambda k: (words[k], k), default=None)
        if over is not None:
            chosen[i, *over] = chosen.get((i, *over), 0) + 1
    if not chosen:
        return {}
    # of each kind so many as are next in the permutation
    asked = _frame(rows, "i int, size long, m long, n int", [(*k, n) for k, n in chosen.items()])
    place = F.row_number().over(Window.partitionBy("i", "size", "m").orderBy("h"))
    ranked = units.join(F.broadcast(asked), ["i", "size", "m"]).withColumn("k", place).where(F.col("k") <= max(chosen.values())).where("k <= n")
    mixed_sizes = {(i, size) for i, counts in kinds.items() for size, m in counts if m > 1}
    whole = F.col("m") == 1
    single = {(r.i, r["size"]): r.end for r in ranked.where(whole).groupBy("i", "size").agg(F.max("h").alias("end")).toLocalIterator()}
    out = {i: Fill({}, frozenset()) for i in kinds}
    for (i, size), end in single.items():
        if (i, size) not in mixed_sizes:
            out[i].ends[size] = end + 1
    if named := mixed_sizes & {k[:2] for k in chosen}:
        some = _frame(rows, "i int, size long", sorted(named))
        for r in ranked.join(F.broadcast(some), ["i", "size"], "left_semi").groupBy("i").agg(F.collect_list("h").alias("h")).toLocalIterator():
            out[r.i] = Fill(out[r.i].ends, frozenset(r.h))
    return out


def _frame(rows: DataFrame, schema: str, values: list[tuple]) -> DataFrame:
    """A row for each source that is still open: as many as sources at most."""
    return rows.sparkSession.createDataFrame(values, schema)


def deal(quotas: list[int], shards: int, seed: int, node: int = 1) -> Iterator[np.ndarray]:
    """Quotas of each shard, left to right."""
    have = np.array(quotas, np.int64)
    if shards == 1:
        yield have
        return
    drawn = halved(have, shards, seed, node)
    yield from deal(drawn.tolist(), shards // 2, seed, 2 * node)
    yield from deal((have - drawn).tolist(), shards - shards // 2, seed, 2 * node + 1)


class Tree:
    """The tree from its root's quotas and seed: which shard owns a block, found from the root down."""

    def __init__(self, quotas: list[int], shards: int, seed: int):
        self.quotas, self.shards, self.seed = np.array(quotas, np.int64), shards, seed
        self._drawn: dict[int, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_drawn": {}}

    def _left(self, node: int, have: np.ndarray, shards: int) -> np.ndarray:
        if node not in self._drawn:
            if (len(self._drawn) + 1) * len(have) > KEPT:
                self._drawn.clear()
            self._drawn[node] = halved(have, shards, self.seed, node)
        return self._drawn[node]

    def shard(self, i: int, block: int) -> int:
        """Of block number `block` of source i's sequence."""
        have, shards, node, first = self.quotas, self.shards, 1, 0
        while shards > 1:
            left, part = self._left(node, have, shards), shards // 2
            if block < left[i]:
                have, shards, node = left, part, 2 * node
            else:
                block, first = block - int(left[i]), first + part
                have, shards, node = have - left, shards - part, 2 * node + 1
        return first


def halved(have: np.ndarray, shards: int, seed: int, node: int) -> np.ndarray:
    """What a node gives to the left of its halves."""
    return draw(have, int(have.sum()) * (shards // 2) // shards, np.random.default_rng([seed, node]))


#: numpy draws from populations below this.
POPULATION = 1_000_000_000


def draw(have: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many blocks of each source are among n of all blocks: multivariate hypergeometric, for populations of any size."""
    total = int(have.sum())
    if total < POPULATION:
        return rng.multivariate_hypergeometric(have, n, method="marginals") if len(have) else have
    # Every block goes left by a coin of n / total. Whatever number that gives, the blocks on the left are a uniform choice of
    # so many, and remain one when uniformly chosen blocks change sides until there are n.
    drawn = rng.binomial(have, n / total)
    surplus = int(drawn.sum()) - n
    pool = drawn if surplus > 0 else have - drawn
    ends = np.cumsum(pool)
    picked: set[int] = set()
    while len(picked) < abs(surplus):
        picked |= set(rng.integers(0, ends[-1], abs(surplus) - len(picked)).tolist())
    moved = np.bincount(np.searchsorted(ends, np.fromiter(picked, np.int64, len(picked)), "right"), minlength=len(have))
    return drawn - moved if surplus > 0 else drawn + moved


def mix(docs: DataFrame, shards: int | None = None, seed: int = 20) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards (those that hold the document's copies, by epoch) for every row."""
    rows = checkpointed(sized(docs, seed))
    return _taken(rows, plan(rows, shards, seed))


def _taken(rows: DataFrame, p: Plan) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(p)

    def batch(part: pa.RecordBatch) -> pa.RecordBatch:
        p: Plan = shared.value
        place = {s: i for i, s in enumerate(p.sources)}
        out: tuple[list, ...] = ([], [], [], [])
        for source, size, h in zip(*(part.column(c).to_pylist() for c in ("source", "size", "h")), strict=True):
            i = place[source]
            held = p.shards(i, h, size)
            for column, value in zip(out, (p.sizes[i], p.targets[i], len(held) * size, held), strict=True):
                column.append(value)
        arrays = [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int32())), strict=True)]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("size"), *arrays], ["doc_id", "size", "source_size", "target", "taken", "shards"])

    return map_batches(rows, batch, "doc_id long, size long, source_size long, target double, taken long, shards array<int>")


def mixed(docs: DataFrame, shards: int | None = None, seed: int = 20) -> DataFrame:
    """documents as the mix holds them: each row as often as it is taken. Copies lie in their shards' partitions, shuffled
    there by a hash."""
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    sizes = checkpointed(sized(rows, seed))
    planned = plan(sizes, shards, seed)
    shared = rows.sparkSession.sparkContext.broadcast(planned)

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = shared.value
        place = {s: i for i, s in enumerate(p.sources)}
        for part in batches:
            row, shard = [], []
            for j, (source, h) in enumerate(zip(part.column("source").to_pylist(), part.column("h").to_pylist(), strict=True)):
                i = place[source]
                held = p.shards(i, h, len(encoded(part.column("text")[j].as_py()).split()) if p.needs_size(i, h) else 0)
                row += [j] * len(held)
                shard += held
            for at in range(0, len(row), 1000):
                out = part.take(pa.array(row[at : at + 1000], pa.int32())).drop_columns(["h"])
                yield out.append_column("shard", pa.array(shard[at : at + 1000], pa.int32()))

    dealt = rows.select("*", _place(seed)).mapInArrow(copies, "doc_id long, text string, lang string, source string, n_chars long, shard int")
    return dealt.repartitionById(planned.n_shards, "shard").sortWithinPartitions("shard", F.xxhash64("shard", "doc_id")).drop("shard")
