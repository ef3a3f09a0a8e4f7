"""Connected components of a graph given as edges.

Each round contracts the edges that a task holds, `PER_TASK` at most on average: whatever they connect becomes a star around
its smallest node. While edges need more than one task, a large-star and a small-star step follow, which link nodes across
tasks, and the next round begins; once they fit one task, or a round changes nothing, the stars are the components.

Links never reach the driver. Nodes with very many links are looked up by broadcast, so that their links aren't dealt to one task;
the aggregations combine before they shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm._common import checkpointed

#: Edges that a task contracts at a time.
PER_TASK = 1_000_000


def components(edges: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """edges: a, b (long). Returns node, root for every node of an edge between different nodes; root is the smallest
    node reachable. Edges with a null, and loops, link nothing."""
    stars = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    before = state = None
    while True:
        now = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        tasks = -(-now.n // per_task)
        # sums that agree are only worth a look; the edges themselves decide
        settled = now == state and stars.exceptAll(before).isEmpty()
        if settled or tasks <= 1:
            stars = stars if settled else checkpointed(_contracted(stars, 1, per_task))
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select("b", "b").distinct())
        before, state = stars, now
        stars = checkpointed(_small_star(_large_star(_contracted(stars, tasks, per_task))))


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges between these, and the smallest node that each reaches."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    x, y = place[: len(a)], place[len(a) :]
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            return nodes, nodes[root]
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while not np.array_equal(nearer := root[root], root):
            root = nearer


def _contracted(stars: DataFrame, tasks: int, per_task: int) -> DataFrame:
    """The edges as stars of what the edges of each task connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def contract() -> tuple[np.ndarray, np.ndarray]:
            nodes, root = roots(np.concatenate([a, *(x for x, _ in held)]), np.concatenate([b, *(y for _, y in held)]))
            return nodes[nodes != root], root[nodes != root]

        for rows in batches:
            held.append(tuple(rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
            size += rows.num_rows
            if size >= per_task:
                (a, b), held, size = contract(), [], 0
                if len(a) >= per_task:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    a = b = np.zeros(0, np.int64)
        a, b = contract()
        for at in range(0, len(a), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 65_536]), pa.array(b[at : at + 65_536])], ["a", "b"])

    return stars.coalesce(tasks).mapInArrow(run, "a long, b long")


def own(column: Column) -> Column:
    """The same long, as a key by which a side that is aggregated by it is dealt anew."""
    return column.bitwiseXOR(F.lit(0).cast("long"))


def _with_least(edges: DataFrame, key: str, least: DataFrame) -> DataFrame:
    """edges with m, which `least` (key, m, n) has for each key. The keys of more than a thousandth of all edges, a thousand at
    most, are broadcast and their edges stay where they are; the others are shuffled."""
    total = edges.count()
    hot = least.where(F.col("n") * 1000 > total)
    many = F.broadcast(hot.select(F.col(key).alias("w"), "m"))
    few = least.where(F.col("n") * 1000 <= total).select(own(F.col(key)).alias("w"), "m")
    rest = edges.join(F.broadcast(hot.select(F.col(key).alias("w"))), F.col(key) == F.col("w"), "left_anti")
    return edges.join(many, F.col(key) == F.col("w")).union(rest.join(few.hint("shuffle_merge"), F.col(key) == F.col("w"))).drop("w")


def _large_star(stars: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour, itself included. a > b in each row."""
    stars = checkpointed(stars)
    both = stars.union(stars.select("b", "a")).toDF("u", "v")
    least = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.when(F.col("v") > F.col("u"), 1)).alias("n")))
    return _with_least(both.where("v > u"), "u", least).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(stars: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to its smallest neighbour."""
    stars = checkpointed(stars)
    least = checkpointed(stars.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
    moved = _with_least(stars, "a", least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).union(moved).distinct()
