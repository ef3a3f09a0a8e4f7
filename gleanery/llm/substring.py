"""Substring deduplication with prefix-partitioned suffix trees.

Words covered by a window of `window` consecutive words that also starts in a document with a smaller id are removed.

A suffix tree over all texts doesn't fit a machine, so its suffixes are split by prefixes into groups that do. Only
suffixes that can share a node as deep as a window are of use, and they are found first:

1. Each window is owned by the least of its runs of `gram` words, by a hash: equal windows have the same owner. Windows
   in a row with one owner form a segment. Owners are counted, packed by shard, and those that occur in one document only
   are dropped: their windows are repeated nowhere.
2. The other segments' suffixes are split by their prefixes: those of an owner go together, as one text for the windows
   they overlap in, and an owner with more than `hot` occurrences is split further, by prefixes as long as a window. What a
   shard holds more than once it sends once, so a group doesn't grow with the copies of a text.
3. Each group numbers its words, equal ones by their bytes, and builds its subtree, in the form of ranks by prefix doubling:
   suffixes that share a rank at the window's depth hang below one internal node. The smallest id below each node goes back to the shards it concerns.
4. Shards mark the windows that start in a smaller id, and join them to maximal repeated stretches.

A passage that very many shards hold would bring a row from each of them to one bucket of step 1 and one group of step 3. Where
there are more than `few` shards, owners that occur in a hundredth of them and more are found in a sample of shards first (as many
as their number's square root). Their windows skip both: each shard sends one row for each, by a digest of all its words, and the
smallest id of a digest is an aggregate that combines before it is shuffled; it goes back by a join that can be split. What the
sample misses costs time only.

Texts are shuffled once, to shards of about `shard_bytes`, and read from there by steps 1, 2 and 4. All sizes are by bytes
of text, so that groups stay as large however many there are.

Null text has no words. A null id counts as larger than any other, and null ids don't remove from one another, nor do rows
with the same id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm._common import checkpointed, encoded, text_bytes

#: Stands for a null id.
LAST = np.iinfo(np.int64).max
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Words hashed at a time.
RUN = 1 << 18
#: Words of a shard whose places fit beside their hashes.
PLACES = 1 << 24

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(max(n, 1 << 16), base)
            factors[0] = 1
            _powers[i] = np.multiply.accumulate(factors)
    return _powers[0][:n], _powers[1][:n]


#: The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """XXH64 of the stretches of `size` bytes, fewer than 32, that begin at `starts`: of all of them at once."""
    eights = np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,))
    fours = np.ndarray((max(0, len(data) - 3),), "<u4", data, 0, (1,))
    h = np.full(len(starts), _P5 + np.uint64(size))
    at = 0
    while size - at >= 8:
        h = _turned(h ^ (_turned(eights[starts + at] * _P2, 31) * _P1), 27) * _P1 + _P4
        at += 8
    if size - at >= 4:
        h = _turned(h ^ (fours[starts + at].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at += 4
    while at < size:
        h = _turned(h ^ (data[starts + at].astype(np.uint64) * _P5), 11) * _P1
        at += 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of texts in one row, joined by single spaces: `data`, where each word starts and ends in it, and the number of
    the first word of each text. Nothing is held for a word but numbers in arrays."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        space = _SPACE[raw]
        after = np.concatenate([[False], ~space[:-1]]) if len(raw) else space
        keep = ~space | after  # a word's bytes, and the one that ends it
        ends_here = space[keep]
        self.data = raw[keep]
        self.data[ends_here] = 32
        self.ends = np.flatnonzero(ends_here)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if len(self.ends) else self.ends
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(np.flatnonzero(~space & ~after), offsets)
        self.bytes = self.data.tobytes()

    def __len__(self) -> int:
        return len(self.ends)

    def joined(self, start: int, end: int) -> bytes:
        return self.bytes[self.starts[start] : self.ends[end - 1]] if start < end else b""

    def hashes(self) -> np.ndarray:
        """XXH64 of each word: of those of one size at once, of 32 bytes and more one by one."""
        out = np.zeros(len(self), np.uint64)
        sizes = self.ends - self.starts
        for at in range(0, len(self), RUN):
            size = sizes[at : at + RUN]
            order = np.argsort(np.minimum(size, 32).astype(np.uint8), kind="stable")
            edges = np.searchsorted(np.minimum(size[order], 32), np.arange(33))
            for n in range(1, 32):
                some = at + order[edges[n] : edges[n + 1]]
                if len(some):
                    out[some] = xxh64(self.data, self.starts[some], n)
            for i in (at + order[edges[32] :]).tolist():
                out[i] = xxhash.xxh64_intdigest(self.joined(i, i + 1))
        return out

    def numbers(self) -> np.ndarray:
        """A number for each word, equal where words are and nowhere else: hashes find what may be equal, bytes decide."""
        _, first, number = np.unique(self.hashes(), return_index=True, return_inverse=True)
        sizes, model = self.ends - self.starts, first[number]
        same = sizes == sizes[model]
        for at in range(0, len(self), RUN):
            rows = at + np.flatnonzero(same[at : at + RUN])
            for step in range(int(sizes[rows].max(initial=0))):
                rows = rows[sizes[rows] > step]
                differ = self.data[self.starts[rows] + step] != self.data[self.starts[model[rows]] + step]
                same[rows[differ]] = False
        further: dict[bytes, int] = {}
        for i in np.flatnonzero(~same).tolist():  # words whose hash another one has
            number[i] = further.setdefault(self.joined(i, i + 1), len(first) + len(further))
        return number


class Shard:
    """The texts of a shard in one row of words, and the segments of their windows."""

    def __init__(self, rows: pa.Table, window: int, gram: int):
        self.window = window
        self.ids = rows.column("doc_id").cast(pa.int64()).fill_null(LAST).to_numpy()
        self.words = Words([encoded(t.as_py()) for t in rows.column("text")])
        self.starts = self.words.first
        n = len(self.words)
        self.first = self.size = self.document = np.zeros(0, np.int64)
        self.owner = np.zeros(0, np.uint64)
        if n < window:
            return
        power, inverse = powers_to(n + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words.hashes() * power[:n])])
        grams = mixed((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
        # windows that lie within one document
        document = np.repeat(np.arange(len(self.ids)), np.diff(self.starts))[: n - window + 1]
        at = np.flatnonzero(np.arange(window, n + 1) <= self.starts[document + 1])
        if not len(at):
            return
        owner = _least(grams, window - gram + 1)[at]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(at) != 1)]))
        self.first, self.size = at[new], np.diff(np.concatenate([new, [len(at)]]))
        self.owner, self.document = grams[owner[new]], document[at[new]]

    def text(self, start: int, windows: int) -> bytes:
        return self.words.joined(start, start + windows + self.window - 1)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value, by its upper 40 bits, the first of equals, in each run of `width` values."""
    n, low = len(values), np.uint64(PLACES - 1)
    if n > PLACES:
        out = np.empty(n - width + 1, np.int64)
        view = np.lib.stride_tricks.sliding_window_view(values >> np.uint64(24), width)
        for at in range(0, len(out), 65_536):
            part = view[at : at + 65_536]
            out[at : at + len(part)] = part.argmin(axis=1) + np.arange(at, at + len(part))
        return out
    # the place stands in the lower bits; minima from each block's start and to its end meet in any run
    blocks = -(-n // width)
    keys = np.full(blocks * width, ~np.uint64(0))
    keys[:n] = (values & ~low) | np.arange(n, dtype=np.uint64)
    keys = keys.reshape(blocks, width)
    before = np.minimum.accumulate(keys, axis=1).reshape(-1)
    after = np.minimum.accumulate(keys[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = n - width + 1
    return (np.minimum(after[:m], before[width - 1 : width - 1 + m]) & low).astype(np.int64)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Key, start, end of the runs of sorted keys."""
    edge = np.flatnonzero(np.diff(keys)) + 1
    for s, e in zip([0, *edge] if len(keys) else [], [*edge, len(keys)], strict=len(keys) > 0):
        yield int(keys[s]), s, e


def _packed(names: list[str], kinds: list[pa.DataType], columns: list[list]) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is among ordered ones."""
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values if len(ordered) else np.zeros(len(values), bool)


def _owners(shard: int, s: Shard, buckets: int, spread: np.ndarray) -> pa.Table:
    """Step 1: the shard's owners with least and greatest id and count, packed by bucket; without those known to be spread."""
    mine = ~_is_in(s.owner, spread)
    order = np.argsort(s.owner[mine], kind="stable")
    owner, ids = s.owner[mine][order], s.ids[s.document[mine][order]]
    new = np.flatnonzero(np.concatenate([[True], np.diff(owner) != 0])) if len(owner) else np.zeros(0, np.int64)
    out: list[list] = [[], [], [], [], [], []]
    if len(new):
        owner, least, most = owner[new], np.minimum.reduceat(ids, new), np.maximum.reduceat(ids, new)
        count = np.diff(np.concatenate([new, [len(ids)]]))
        bucket = (owner >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        for key, a, b in _runs(bucket[order]):
            rows = order[a:b]
            for column, value in zip(out, (key, shard, *(x[rows].tobytes() for x in (owner, least, most, count))), strict=True):
                column.append(value)
    return _packed(["bucket", "shard", "owner", "least", "most", "n"], [pa.int32(), pa.int32(), *[pa.binary()] * 4], out)


def _repeated(rows: pa.Table, hot: int) -> pa.Table:
    """Still step 1: owners that occur in documents of different ids, packed for each shard that has them."""
    owner, least, most, count = (np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in (("owner", np.uint64), ("least", np.int64), ("most", np.int64), ("n", np.int64)))
    shard = np.repeat(rows.column("shard").to_numpy(), [len(x) // 8 for x in rows.column("owner").to_pylist()])
    order = np.argsort(owner, kind="stable")
    owner, shard = owner[order], shard[order]
    new = np.flatnonzero(np.concatenate([[True], np.diff(owner) != 0]))
    sizes = np.diff(np.concatenate([new, [len(owner)]]))
    several = np.repeat(np.minimum.reduceat(least[order], new) < np.maximum.reduceat(most[order], new), sizes)
    many = np.repeat(np.add.reduceat(count[order], new) > hot, sizes)
    keep = np.flatnonzero(several)
    keep = keep[np.argsort(shard[keep], kind="stable")]
    out: list[list] = [[], [], []]
    for key, a, b in _runs(shard[keep]):
        for column, value in zip(out, (key, owner[keep[a:b]].tobytes(), many[keep[a:b]].tobytes()), strict=True):
            column.append(value)
    return _packed(["shard", "owner", "hot"], [pa.int32(), pa.binary(), pa.binary()], out)


def _found(s: Shard, owners: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Segments whose owner is among those packed, and whether it is a hot one."""
    owner = np.frombuffer(b"".join(owners.column("owner").to_pylist()), np.uint64)
    hot = np.frombuffer(b"".join(owners.column("hot").to_pylist()), bool)
    if not len(owner) or not len(s.owner):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    order = np.argsort(owner, kind="stable")
    owner, hot = owner[order], hot[order]
    place = np.minimum(np.searchsorted(owner, s.owner), len(owner) - 1)
    rows = np.flatnonzero(owner[place] == s.owner)
    return rows, hot[place[rows]]


def _spread_owners(texts: DataFrame, shards: int, window: int, gram: int, few: int) -> np.ndarray:
    """Owners that a hundredth of all shards and more hold, from a sample of shards: a hundred times a shard's owners at most."""
    if shards <= few:
        return np.zeros(0, np.uint64)
    step = max(1, shards // max(1, int(shards**0.5)))
    sampled = -(-shards // step)

    def owners(rows: pa.Table) -> pa.Table:
        return pa.table({"owner": pa.array(np.unique(Shard(rows, window, gram).owner).view(np.int64))})

    counts = texts.where(F.col("shard") % step == 0).groupBy("shard").applyInArrow(owners, "owner long").groupBy("owner").count()
    many = counts.where(F.col("count") > max(2, sampled // 100))
    return np.sort(np.array([r.owner for r in many.toLocalIterator()], np.int64).view(np.uint64))


def _suffixes(shard: int, s: Shard, owners: pa.Table, groups: int, spread: np.ndarray) -> pa.Table:
    """Step 2: texts of repeated owners' segments, or of their single windows where the owner is hot, once each; of the windows of
    spread owners the digests, in group -1."""
    seen: dict[tuple[int, bool, bytes], list[int]] = {}
    rows, hots = _found(s, owners)
    if len(spread):
        more = np.flatnonzero(_is_in(s.owner, spread))
        rows, hots = np.concatenate([rows, more]), np.concatenate([hots, np.ones(len(more), bool)])
    for j, hot in zip(rows.tolist(), hots.tolist(), strict=True):
        first, size, owner, key = int(s.first[j]), int(s.size[j]), int(s.owner[j]), int(s.ids[s.document[j]])
        for part in ((owner, True, s.text(first + t, 1)) for t in range(size)) if hot else ((owner, False, s.text(first, size)),):
            if (had := seen.get(part)) is None:
                seen[part] = [key, key]
            else:
                had[0], had[1] = min(had[0], key), max(had[1], key)
    out: list[list] = [[], [], [], [], [], [], []]
    apart = set(spread.tolist())
    for (owner, hot, text), (least, most) in seen.items():
        if owner in apart:
            prefix, text = -1, xxhash.xxh3_128_digest(text)
        else:
            prefix = ((xxhash.xxh64_intdigest(text) if hot else owner) >> 20) % groups
        for column, value in zip(out, (prefix, shard, owner - (1 << 63), hot, text, least, most), strict=True):
            column.append(value)
    return _packed(["prefix", "shard", "owner", "hot", "text", "least", "most"], [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64()], out)


def nodes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix of a row of symbols, its rank by its first `depth` symbols, by prefix doubling: suffixes of equal
    rank are the leaves below one node of that depth. Suffixes that are shorter get ranks nobody should use."""
    rank, length = symbols, 1
    while length < depth:
        step = min(length, depth - length)
        if len(rank) <= step:
            return np.zeros(0, np.int64)
        pair = rank[:-step].astype(np.int64) * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        length += step
    return rank


def _subtree(rows: pa.Table, window: int) -> pa.Table:
    """Step 3: for each text of a group the least id below its windows' nodes, where that is less than an id of its shard."""
    texts = rows.column("text").to_pylist()
    words = Words(texts)
    count = np.diff(words.first) - window + 1
    # every window lies within its text, so texts need no end marks between them
    at = np.repeat(words.first[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    node = nodes(words.numbers(), window)[at]
    least = np.full(int(node.max()) + 1, LAST, np.int64)
    np.minimum.at(least, node, np.repeat(rows.column("least").to_numpy(), count))
    least = least[node]
    edges = np.cumsum(count) - count
    wanted = np.flatnonzero(np.minimum.reduceat(least, edges) < rows.column("most").to_numpy())
    kept = rows.select(["shard", "owner", "hot"]).take(pa.array(wanted))
    digests = pa.array([xxhash.xxh3_128_digest(texts[j]) for j in wanted.tolist()], pa.binary())
    firsts = pa.array([least[a:b].tobytes() for a, b in zip(edges[wanted].tolist(), (edges + count)[wanted].tolist(), strict=True)], pa.binary())
    return kept.append_column("digest", digests).append_column("least", firsts)


def _marked(s: Shard, found: pa.Table) -> pa.Table:
    """Step 4: what is left of each document."""
    owners, hots = found.column("owner").to_pylist(), found.column("hot").to_pylist()
    least = {d: np.frombuffer(b, np.int64) for d, b in zip(found.column("digest").to_pylist(), found.column("least").to_pylist(), strict=True)}
    packed = pa.table({"owner": [np.array([o + (1 << 63)], np.uint64).tobytes() for o in owners], "hot": [bytes([h]) for h in hots]}, schema=pa.schema([("owner", pa.binary()), ("hot", pa.binary())]))
    n = len(s.words)
    change = np.zeros(n + 1, np.int64)
    rows, hot = _found(s, packed)
    for j, single in zip(rows.tolist(), hot.tolist(), strict=True):
        first, size, key = int(s.first[j]), int(s.size[j]), s.ids[s.document[j]]
        if single:
            starts = [first + t for t in range(size) if (x := least.get(xxhash.xxh3_128_digest(s.text(first + t, 1)))) is not None and x[0] < key]
        elif (x := least.get(xxhash.xxh3_128_digest(s.text(first, size)))) is not None:
            starts = first + np.flatnonzero(x < key)
        else:
            continue
        starts = np.array(starts, np.int64)
        change[starts] += 1
        change[starts + s.window] -= 1  # windows start at different words
    covered = np.cumsum(change[:n]) > 0
    out: list[list] = [[], [], [], [], []]
    for i, key in enumerate(s.ids.tolist()):
        a, b = int(s.starts[i]), int(s.starts[i + 1])
        here = covered[a:b]
        turns = np.flatnonzero(np.diff(np.concatenate([[False], here, [False]]))).tolist()
        edges = [0, *turns, b - a]
        kept = [s.words.joined(a + x, a + y) for x, y in zip(edges[::2], edges[1::2], strict=True) if x < y]
        values = None if key == LAST else key, b - a, int(here.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), turns
        for column, value in zip(out, values, strict=True):
            column.append(value)
    return _packed(["doc_id", "n_words", "n_removed", "kept_sha256", "spans"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32())], out)


def _least_of_digests(sent: DataFrame) -> DataFrame:
    """Step 3 for the windows of spread owners: rows as _subtree gives them."""
    least = sent.groupBy("text").agg(F.min("least").alias("first")).select(F.concat("text", F.lit(b"")).alias("digest"), "first")
    joined = sent.join(least.hint("shuffle_merge"), F.col("text") == F.col("digest")).where("first < most")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            firsts = [int(x).to_bytes(8, "little", signed=True) for x in rows.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(firsts, pa.binary())], ["shard", "owner", "hot", "digest", "least"])

    return joined.select("shard", "owner", "hot", "digest", "first").mapInArrow(packed, "shard int, owner long, hot boolean, digest binary, least binary")


def substring_dedup(df: DataFrame, window: int = 50, gram: int = 20, shard_bytes: int = 4_000_000, group_bytes: int = 12_000_000, hot: int = 2048, few: int = 4096) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (removed stretches as start, end, start, end ... in words) for every
    row."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = text_bytes(docs)
    shards, groups = max(1, -(-size // shard_bytes)), max(1, -(-size // group_bytes))
    # the hash takes the text in, so that rows without an id, or with the same, are spread too
    texts = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int"))

    shared = df.sparkSession.sparkContext.broadcast(_spread_owners(texts, shards, window, gram, few))
    any_spread = len(shared.value) > 0

    def owners(key, rows):
        return _owners(key[0].as_py(), Shard(rows, window, gram), groups, shared.value)

    def suffixes(key, rows, found):
        return _suffixes(key[0].as_py(), Shard(rows if found.num_rows or any_spread else rows.slice(0, 0), window, gram), found, groups, shared.value)

    def marked(rows, found):
        return _marked(Shard(rows, window, gram), found)

    counted = texts.groupBy("shard").applyInArrow(owners, "bucket int, shard int, owner binary, least binary, most binary, n binary")
    repeated = counted.groupBy("bucket").applyInArrow(lambda rows: _repeated(rows, hot), "shard int, owner binary, hot binary")
    sent = texts.groupBy("shard").cogroup(repeated.groupBy("shard")).applyInArrow(suffixes, "prefix int, shard int, owner long, hot boolean, text binary, least long, most long")
    if any_spread:
        sent = checkpointed(sent)
    found = sent.where("prefix >= 0").groupBy("prefix").applyInArrow(lambda rows: _subtree(rows, window), "shard int, owner long, hot boolean, digest binary, least binary")
    if any_spread:
        found = found.union(_least_of_digests(sent.where("prefix < 0")))
    return texts.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(marked, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<int>")
