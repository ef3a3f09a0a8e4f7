"""SimHash near-duplicate detection by pigeonhole blocks.

A fingerprint's 64 bits are the majority over the XXH64 (seed 42) of a text's word shingles. Two fingerprints that differ
in `distance` bits at most agree on at least `blocks - distance` of any `blocks` blocks of bits, so they share a key for
some choice of that many blocks: fingerprints are dealt by these keys, and those that share one are verified.

Texts with the same fingerprint are first taken as one. Of those that share a key no pairs are listed: each key's
fingerprints are searched breadth first, and what leaves the search is a spanning forest, fewer links than fingerprints,
which connects what all links connect. Components of these forests are components of all links. `gleanery.llm.copies` takes
its links as candidates for copies by the similarity of shingles.

A null text counts as empty. The fingerprint of no words is zero, and linked like any other. Null doc_ids get a
component, but name none unless no other member has an id; repeated rows are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm._common import checkpointed, encoded, looked_up, map_batches
from gleanery.llm.components import components

#: Shingles whose bits are counted at a time.
RUN = 16_384


def fingerprint(text: str | None, width: int = 4) -> int:
    """64 bits of a text; A-Z in lower case, shingles of `width` words with repeats, fewer words as one shingle."""
    tokens = encoded(text).lower().split()  # of bytes: A-Z only
    if not tokens:
        return 0
    if len(tokens) < width:
        return xxhash.xxh64_intdigest(b" ".join(tokens), 42)
    n = len(tokens) - width + 1
    digest, joined = xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros(64, np.int64)
    for at in range(0, n, RUN):
        hashes = np.array([digest(joined(tokens[i : i + width]), 42) for i in range(at, min(n, at + RUN))], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) for every row."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, width) for t in rows.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(found)], ["doc_id", "fp"])

    return map_batches(df.select("doc_id", "text"), batch, "doc_id long, fp long")


def choices(blocks: int, distance: int) -> list[int]:
    """Masks of each choice of `blocks - distance` blocks."""
    return _masked(list(range(64)), blocks, blocks - distance)


def _masked(bits: list[int], groups: int, agree: int) -> list[int]:
    """Masks of each choice of `agree` of so many groups of these bits."""
    edges = [round(len(bits) * i / groups) for i in range(groups + 1)]
    masks = [sum(1 << x for x in bits[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(masks, agree)]


def longer(mask: int, distance: int) -> list[int]:
    """Masks for a key that too many fingerprints share: of its other bits in `distance` + 2 groups, any two agree."""
    return [mask | x for x in _masked([i for i in range(64) if not mask >> i & 1], distance + 2, 2)]


def links(prints: DataFrame, distance: int = 4, blocks: int = 8, hot: int = 20_000) -> DataFrame:
    """prints: fp, node (a long that stands for the fingerprint's texts). Returns a, b: links between nodes of fingerprints
    within `distance` bits that connect what all such links connect. With 8 blocks keys hold 32 bits, so that unrelated
    fingerprints rarely share one even among billions. Keys of more than about `hot` fingerprints, counted in a 64th of the
    fingerprints, are made longer by further blocks, so that a large family of near copies is dealt to many tasks and none
    compares more than some `hot` with one another. The keys known as hot are at most 70 * 64 in `hot` rows."""
    masks = choices(blocks, distance)
    context = prints.sparkSession.sparkContext

    def keyed(batches: Iterator[pa.RecordBatch], hot_keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        def batch(keys: list[np.ndarray], fps: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (keys, fps, nodes)], ["k", "fp", "node"])

        for rows in batches:
            columns = [rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            for at in range(0, rows.num_rows, 4096):
                part, node = columns[0][at : at + 4096].view(np.uint64), columns[1][at : at + 4096].view(np.uint64)
                out: tuple[list, ...] = ([], [], [])
                for i, m in enumerate(masks):
                    k = _mixed(part & np.uint64(m), i)
                    is_hot = hot_keys[np.minimum(np.searchsorted(hot_keys, k), len(hot_keys) - 1)] == k if len(hot_keys) else np.zeros(len(k), bool)
                    if is_hot.any():
                        x, n = part[is_hot], node[is_hot]
                        for j, more in enumerate(longer(m, distance)):
                            for column, value in zip(out, (_mixed(x & np.uint64(more), len(masks) * (j + 1) + i), x, n), strict=True):
                                column.append(value)
                        k, x, n = k[~is_hot], part[~is_hot], node[~is_hot]
                    else:
                        x, n = part, node
                    for column, value in zip(out, (k, x, n), strict=True):
                        column.append(value)
                yield batch(*out)

    sample = prints.select("fp", "node").where(F.pmod(F.xxhash64("fp"), F.lit(64)) == 0)
    counted = sample.mapInArrow(lambda batches: keyed(batches, np.zeros(0, np.uint64)), "k long, fp long, node long").groupBy("k").count()
    found = np.array([r.k for r in counted.where(F.col("count") > hot // 64).toLocalIterator()], np.int64).view(np.uint64)
    shared = context.broadcast(np.sort(found))

    dealt = prints.select("fp", "node").mapInArrow(lambda batches: keyed(batches, shared.value), "k long, fp long, node long")
    # Without the sort's help a key's rows are together only within a partition, which is all that is needed.
    dealt = dealt.repartition("k").sortWithinPartitions("k")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # rows of the last key, which may go on in the next batch
        for rows in batches:
            if not rows.num_rows:
                continue
            columns = tuple(rows.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cut = int(np.searchsorted(columns[0], columns[0][-1], "left"))
            if held and columns[0][0] != held[0][0][0]:
                yield _forest(*map(np.concatenate, zip(*held, strict=True)), distance)
                held = []
            if cut:
                yield _forest(*map(np.concatenate, zip(*held, tuple(x[:cut] for x in columns), strict=True)), distance)
                held = []
            held.append(tuple(x[cut:] for x in columns))
        if held:
            yield _forest(*map(np.concatenate, zip(*held, strict=True)), distance)

    return dealt.mapInArrow(search, "a long, b long").distinct()


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Keys of different choices apart: a bijection of 64 bits for each. Keys that meet nevertheless only cost a
    comparison."""
    x = x ^ np.uint64(int.from_bytes(hashlib.blake2b(bytes([salt % 256, salt // 256]), digest_size=8).digest(), "little"))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _forest(k: np.ndarray, fp: np.ndarray, node: np.ndarray, distance: int) -> pa.RecordBatch:
    """A spanning forest of the links within each run of equal keys."""
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(k) > 1:
        edge = np.flatnonzero(np.diff(k)) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(k)]])
        sizes = ends - starts
        pairs = starts[sizes == 2]
        if len(pairs):
            near = np.bitwise_count((fp[pairs] ^ fp[pairs + 1]).view(np.uint64)) <= distance
            out_a.append(node[pairs][near])
            out_b.append(node[pairs + 1][near])
        for s, e in zip(starts[sizes > 2], ends[sizes > 2], strict=True):
            left, name = fp[s:e], node[s:e]
            while len(left) > 1:
                queue, left, name = [(left[0], name[0])], left[1:], name[1:]
                while queue and len(left):
                    x, n = queue.pop()
                    near = np.bitwise_count((left ^ x).view(np.uint64)) <= distance
                    if near.any():
                        queue.extend(zip(left[near], name[near], strict=True))
                        out_a.append(np.full(int(near.sum()), n))
                        out_b.append(name[near])
                        left, name = left[~near], name[~near]
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])


def near_duplicates(df: DataFrame, width: int = 4, distance: int = 4, blocks: int = 8) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links lead to, itself included."""
    prints = checkpointed(fingerprints(df, width))
    # min() passes over nulls, so a null id names a component only where there is no other
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    roots = components(links(firsts.select("fp", F.col("fp").alias("node")), distance, blocks))
    least = checkpointed(firsts.join(roots, firsts["fp"] == roots["node"]).groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("nodes")))
    # fingerprints without links keep their own first; the others take their component's, of which a large one is a hot key
    linked = looked_up(roots, least, ["root"], "nodes").select(F.col("node").alias("fp"), "least")
    # read back from files, it is dealt anew for the last join, which adaptive execution can then split
    component = checkpointed(firsts.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"), "n"))
    # copies by the thousand share a fingerprint: a hot key, looked up by broadcast
    return looked_up(prints, component, ["fp"], "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
