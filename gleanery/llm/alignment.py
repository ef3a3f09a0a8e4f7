"""Alignment of two tokenizers over the same bytes.

A text is encoded by A, a byte-level vocabulary of the tokenizers library, and by B, a vocabulary of the sentencepiece library, which
adds the leading space that A is given. Both cut the same bytes. B's tokens are a static index of intervals: their ends, in order. A
token of A is looked up in it by bisection of its two ends, which gives the run of B's tokens that it overlaps; where no token of
either spans a gap, a group ends.

Texts are aligned stretch by stretch. A space begins a new stretch where both vocabularies cut there whatever stands around it: where
no run of spaces, no other white space and no word mark comes next to it (`stretches`). Stretches repeat, so workers keep their
alignments; other texts are aligned as a whole. Where the joined bytes of either differ from the text's, it has no tokens.

Linked pairs of ids are counted over the corpus by documents: a text's pairs are packed beside its row, tasks count them before the
shuffle, and each A id's highest count is found. Each text then looks its pairs up: the most frequent, which every task holds, from a
broadcast table of `keep` pairs at most, and the rest, which are rare, through a join. So no pair that many texts have is a hot key.

Null text counts as empty. Every row gives one row and is a document of its own, whether or not its id is null or repeated.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm._common import checkpointed, map_slices, sliced
from gleanery.llm.sentencepiece_codec import MARK

#: Stretches after which a worker's cache begins to forget, the characters of one that it keeps at most, and stretches that are
#: encoded as one text.
CACHE, LONG, TOGETHER = 150_000, 64, 100
#: Distinct pairs that a task counts before it hands them on.
HELD = 2_000_000
#: Pairs of the broadcast table at most.
KEEP = 1_000_000
_UNSAFE = re.compile(rf"(?:\A| )(?:\s|\Z)|{MARK}")
PAIRS = "pairs binary, times binary"


def byte_characters() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable ones of Latin-1 stand for themselves, the others, in order,
    for characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Two vocabularies."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        of = byte_characters()
        entries = self.a.get_vocab(with_added_tokens=True)
        # an entry that isn't of bytes, a special one, has none: no text's bytes are made with it
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for t, i in entries.items():
            self.bytes_a[i] = bytes(of[c] for c in t) if all(c in of for c in t) else b""
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(MARK, " ").encode() for i in range(self.b.get_piece_size())]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x))) for x in (self.bytes_a, self.bytes_b))
        self.names = list(map(str, range(max(len(self.bytes_a), len(self.bytes_b)))))

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        return list(zip((x.ids for x in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)), self.b.encode(texts, num_threads=1), strict=True))


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each A token the first B token it overlaps and the one after the last, and whether a group ends with it. `ends_b` is the
    index; an A token is a query by its two ends."""
    starts_a = np.concatenate([[0], ends_a[:-1]]).astype(np.int64)
    first = np.searchsorted(ends_b, starts_a, "right")  # the first that ends after the start
    after = np.searchsorted(ends_b, ends_a, "left") + 1  # the first that reaches the end is the last
    return first, after, ends_b[after - 1] == ends_a  # else the gap lies within a B token


#: Numbers of A's tokens, B's and groups, the groups as text, and the linked pairs, repeats included, as packed longs.
Alignment = tuple[int, int, int, str, bytes]
NOTHING: Alignment = (0, 0, 0, "", b"")


def aligned(pair: Pair, texts: list[str], together: int = 1) -> list[Alignment | None]:
    """Alignments of texts, laid end to end so that all are looked up at once: both tokenizers cut where one ends. So many at a time
    are encoded as one text, which takes stretches. None where either's bytes are others than a space's and the text's."""
    out: list[Alignment | None] = [None] * len(texts)
    fine: list[int] = []
    ids: list[tuple[list[int], list[int]]] = []
    groups = range(0, len(texts), together)
    joined = [" ".join(texts[i : i + together]) for i in groups]
    for at, whole, found in zip(groups, joined, pair.encode(joined), strict=True):
        want = b" " + whole.encode()
        if all(b"".join(map(known.__getitem__, x)) == want for known, x in zip((pair.bytes_a, pair.bytes_b), found, strict=True)):
            fine += range(at, min(at + together, len(texts)))
            ids.append(found)
        elif together > 1:
            out[at : at + together] = aligned(pair, texts[at : at + together])
    if not fine:
        return out
    flat_a, flat_b = (np.fromiter(chain.from_iterable(x[k] for x in ids), np.int64, sum(len(x[k]) for x in ids)) for k in (0, 1))
    ends_a, ends_b = np.cumsum(pair.sizes_a[flat_a]), np.cumsum(pair.sizes_b[flat_b])
    ends = np.cumsum([len(texts[i].encode()) + 1 for i in fine])
    upto_a, upto_b = (np.minimum(np.searchsorted(x, ends) + 1, len(x)) for x in (ends_a, ends_b))
    if together > 1 and not ((ends_a[upto_a - 1] == ends).all() and (ends_b[upto_b - 1] == ends).all()):
        return aligned(pair, texts)  # no stretches after all
    first, after, closes = align(ends_a, ends_b)
    wide = after - first
    at_b = np.repeat(first - np.cumsum(wide) + wide, wide) + np.arange(wide.sum())
    links = (np.repeat(flat_a, wide) << 32 | flat_b[at_b]).tobytes()
    # each group's tokens of A, then of B, with what stands after each
    last_b = np.zeros(len(flat_b), bool)
    last_b[after[closes] - 1] = True
    group_a, group_b = np.cumsum(closes) - closes, np.cumsum(last_b) - last_b
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    marks = np.concatenate([np.where(closes, 1, 0), np.where(last_b, 2, 0)])[order].tolist()
    names = list(map(add, map(pair.names.__getitem__, np.concatenate([flat_a, flat_b])[order].tolist()), map((",", "|", ";").__getitem__, marks)))
    upto_links, upto_groups, upto = 8 * np.cumsum(wide)[upto_a - 1], np.cumsum(closes)[upto_a - 1], upto_a + upto_b
    n_a, n_b, n = (np.diff(x, prepend=0).tolist() for x in (upto_a, upto_b, upto_groups))
    starts, link_starts = [0, *upto[:-1].tolist()], [0, *upto_links[:-1].tolist()]
    for i, *counts, x, y, s, e in zip(fine, n_a, n_b, n, starts, upto.tolist(), link_starts, upto_links.tolist(), strict=True):
        out[i] = counts[0], counts[1], counts[2], "".join(names[x:y])[:-1], links[s:e]
    return out


def stretches(text: str) -> list[str] | None:
    """What lies between a text's spaces, or None where that isn't safe. A's pattern takes a space with what follows it unless that is
    white space, and B begins a piece with a space unless another one comes before; so no stretch may be empty, or begin with white
    space, and none may hold a word mark, which B reads as a space."""
    return None if _UNSAFE.search(text) else text.split(" ")


class Aligner:
    """Alignments of texts, with those of stretches kept: the last that were asked for, CACHE to twice as many."""

    def __init__(self, pair: Pair):
        self.pair, self.kept, self.older = pair, {}, {}

    def texts(self, texts: list[str]) -> list[Alignment]:
        parted = [stretches(t) if t else [] for t in texts]
        if len(self.kept) > CACHE:
            self.kept, self.older = {}, self.kept
        wanted = {p for parts in parted for p in parts or ()} - self.kept.keys()
        self.kept |= {p: self.older[p] for p in wanted & self.older.keys()}
        new = list(wanted - self.kept.keys())
        self.kept |= zip(new, aligned(self.pair, new, TOGETHER), strict=True)
        whole = [i for i, parts in enumerate(parted) if parts is None]
        apart = dict(zip(whole, aligned(self.pair, [texts[i] for i in whole]), strict=True))
        out = [self._joined(list(map(self.kept.__getitem__, parts))) if parts is not None else apart[i] or NOTHING for i, parts in enumerate(parted)]
        for p in new:
            if len(p) > LONG:
                del self.kept[p]
        return out

    @staticmethod
    def _joined(parts: list[Alignment | None]) -> Alignment:
        if None in parts or not parts:
            return NOTHING
        a, b, groups, names, links = zip(*parts, strict=True)
        return sum(a), sum(b), sum(groups), ";".join(names), b"".join(links)


_aligners: dict[str, Aligner] = {}


def aligner_of(a: bytes, b: bytes) -> Aligner:
    """One for each worker process and pair of vocabularies."""
    key = hashlib.sha256(a).hexdigest() + hashlib.sha256(b).hexdigest()
    if key not in _aligners:
        _aligners[key] = Aligner(Pair(a, b))
    return _aligners[key]


def alignments(df: DataFrame, a: bytes, b: bytes) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (as text), pairs and times (distinct linked pairs as packed longs in order, and how
    often the text has each, as packed unsigned ints) for every row of df."""
    shared = df.sparkSession.sparkContext.broadcast((a, b))

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = aligner_of(*shared.value).texts([t or "" for t in rows.column(1).to_pylist()])
        counted = [np.unique(np.frombuffer(x[4], np.uint64), return_counts=True) for x in found]
        columns = [pa.array([x[i] for x in found], pa.int64()) for i in range(3)]
        columns += [pa.array([len(x[4]) // 8 for x in found], pa.int64()), pa.array([x[3] for x in found], pa.string())]
        columns += [pa.array([p.tobytes() for p, _ in counted], pa.binary()), pa.array([array("I", n.tolist()).tobytes() for _, n in counted], pa.binary())]
        return pa.RecordBatch.from_arrays([rows.column(0), *columns], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    return map_slices(df.select(F.col("doc_id").cast("long"), "text"), batch, f"doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, {PAIRS}", size=1_000_000)


def pair_counts(rows: DataFrame, held: int = HELD) -> DataFrame:
    """pair, n, best for the pairs of rows (pairs): the number of rows that have it, and whether that is its A id's highest."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate([*waiting, np.zeros(0, np.uint64)]), return_counts=True)
            both, place = np.unique(np.concatenate([pairs, new]), return_inverse=True)
            return both, np.bincount(place, np.concatenate([counts, n]), len(both)).astype(np.int64)

        for batch in batches:
            for part in sliced(batch, 0):
                waiting.append(np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint64))
                size += len(waiting[-1])
                if size > held:
                    (pairs, counts), waiting, size = merged(), [], 0
                    if len(pairs) > held:
                        yield from _batches(["pair", "n"], pairs.view(np.int64), counts)
                        pairs, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield from _batches(["pair", "n"], *(x.view(np.int64) for x in merged()))

    counted = checkpointed(rows.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    a = F.shiftrightunsigned("pair", 32)
    # at most one row for each id of A's vocabulary
    highest = F.broadcast(counted.groupBy(a.alias("a")).agg(F.max("n").alias("most")))
    return counted.withColumn("a", a).join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _batches(names: list[str], *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), 65_536):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 65_536]) for c in columns], names)


def frequent_from(counts: DataFrame, keep: int) -> int:
    """The least power of two such that `keep` pairs at most are in so many rows or more."""
    sizes = {r.power: r["count"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().collect()}
    power, total = max(sizes, default=0) + 1, 0
    while power > 0 and total + sizes.get(power - 1, 0) <= keep:
        power -= 1
        total += sizes.get(power, 0)
    return 1 << power


def with_counts(rows: DataFrame, counts: DataFrame, keep: int = KEEP) -> DataFrame:
    """rows (row, an id of its own; pairs, times) with n_best and count_sum for pairs and times."""
    spark = rows.sparkSession
    least = frequent_from(counts, keep)
    # `keep` rows at most
    table = counts.where(F.col("n") >= least).toArrow()
    order = np.argsort(pairs := table.column("pair").to_numpy().view(np.uint64))
    shared = spark.sparkContext.broadcast(tuple(x[order].tobytes() for x in (pairs, table.column("n").to_numpy(), table.column("best").to_numpy().astype(np.uint8))))
    rest = [c for c in rows.columns if c not in ("pairs", "times")]
    kinds = ", ".join(f"{c} {k}" for c, k in rows.dtypes if c in rest)

    def batch(part: pa.RecordBatch) -> pa.RecordBatch:
        known, n, best = (np.frombuffer(x, t) for x, t in zip(shared.value, (np.uint64, np.int64, np.uint8), strict=True))
        sizes = np.array([len(x) // 4 for x in part.column("times").to_pylist()])
        flat, times = (np.frombuffer(b"".join(part.column(c).to_pylist()), t) for c, t in (("pairs", np.uint64), ("times", np.uint32)))
        at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
        hit = known[at] == flat if len(known) else np.zeros(len(flat), bool)
        row = np.repeat(np.arange(len(sizes)), sizes)
        sums = [_sums(row[hit], times[hit].astype(np.int64) * x[at[hit]], len(sizes)) for x in (best, n)]
        left = np.bincount(row[~hit], minlength=len(sizes))
        edges = np.cumsum(left)[:-1]
        packed = [pa.array([x.tobytes() for x in np.split(flat[~hit], edges)], pa.binary()), pa.array([x.tobytes() for x in np.split(times[~hit], edges)], pa.binary())]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *map(pa.array, sums), *packed], [*rest, "n_best", "count_sum", "pairs", "times"])

    first = map_slices(rows.select(rest[0], "pairs", "times", *rest[1:]), batch, f"{kinds}, n_best long, count_sum long, {PAIRS}")

    def missed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part in sliced(rows, 1, 1_000_000):
                sizes = [len(x) // 4 for x in part.column(2).to_pylist()]
                pairs, times = (np.frombuffer(b"".join(part.column(i).to_pylist()), t) for i, t in ((1, np.int64), (2, np.uint32)))
                yield from _batches(["row", "p", "t"], np.repeat(part.column(0).to_numpy(), sizes), pairs, times.astype(np.int64))

    first = checkpointed(first)
    rare = first.where(F.octet_length("pairs") > 0).select("row", "pairs", "times").mapInArrow(missed, "row long, p long, t long")
    found = rare.join(counts.where(F.col("n") < least), F.col("p") == F.col("pair"))
    more = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("b"), F.sum(F.col("t") * F.col("n")).alias("c")).withColumnRenamed("row", "r")
    joined = first.drop("pairs", "times").join(more, F.col("row") == F.col("r"), "left")
    added = [(F.col(x) + F.coalesce(F.col(y), F.lit(0))).alias(x) for x, y in (("n_best", "b"), ("count_sum", "c"))]
    return joined.select(*rest, *added)


def _sums(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums by row, in whole numbers; rows are in order."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    edges = np.searchsorted(row, np.arange(n + 1))
    return total[edges[1:]] - total[edges[:-1]]


def digests(df: DataFrame, a: bytes, b: bytes, keep: int = KEEP, held: int = HELD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of df."""
    rows = alignments(df, a, b)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    # read back from files, rows keep the ids they have there
    rows = checkpointed(rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs", "times", F.monotonically_increasing_id().alias("row")))
    counts = checkpointed(pair_counts(rows, held))
    out = with_counts(rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"), counts, keep)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
