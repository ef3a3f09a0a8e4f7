"""Streams that remember: first-wins deduplication of contents, change between two runs, and what was visited, read from state.

Each function takes a stream or a batch, and a stream that has read all there is leaves what the batch gives. State lies in RocksDB in
the stream's checkpoint, which a stopped stream goes on from and `state_of` reads without it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleanery.session import shared_folder
from gleanery.streaming.captures import watermarked

# The driver's own Python runner of custom state doesn't see packages that were sent to executors, so what it runs travels whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ACCEPTED, DUPLICATE = "accepted", "content_duplicate"
STATE = "first"


class _FirstWins(StatefulProcessor):
    """For each hash the first row's name and place, kept for `days` days after it came, or for ever. State is asked once for a hash and
    batch, and told once of a new one: each call goes to the JVM and back, and most hashes have one row."""

    def __init__(self, days: float | None):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = None if self.days is None else int(self.days * 86_400_000)
        self.first = handle.getValueState(STATE, "name string, place long", ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came = sorted((row.place, row.name) for row in rows)
        first, outcome = self.first.get(), DUPLICATE
        if first is None:
            first, outcome = (came[0][1], came[0][0]), ACCEPTED
            self.first.update(first)
        for _, name in came:
            yield Row(name=name, hash=key[0], outcome=outcome, first=first[0])
            outcome = DUPLICATE

    def close(self) -> None:
        pass


def first_wins(df: DataFrame, name: str, hash_: str, place: str, days: float | None = None) -> DataFrame:
    """name, hash, outcome (accepted, or content_duplicate where an earlier row has the hash) and first (that row's name) of every row,
    as two outputs in one. In a stream the first is the one that came first, of those of one batch the one of the least place; a hash
    is forgotten after `days` days, where that is given. Names are texts; null hashes are a hash of their own. Names
    and places of one hash's rows of one batch are held and sorted by its task, as any of them may be the first; nulls are places before all others."""
    rows = df.select(F.coalesce(F.col(hash_), F.lit("")).alias("hash"), F.coalesce(F.col(name).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(place).cast("long"), F.lit(-(1 << 63))).alias("place"))
    if not df.isStreaming:
        least = rows.groupBy("hash").agg(F.min(F.struct("place", "name")).alias("_f"))
        met = rows.join(least.select(F.col("hash").alias("_h"), "_f").hint("shuffle_merge"), F.col("hash") == F.col("_h"))
        return met.select(F.col("name").alias("name"), "hash", F.when(F.struct("place", "name") == F.col("_f"), ACCEPTED).otherwise(DUPLICATE).alias("outcome"), F.col("_f.name").alias("first"))
    df.sparkSession.conf.set(PROVIDER, ROCKSDB)
    return rows.groupBy("hash").transformWithState(_FirstWins(days), "name string, hash string, outcome string, first string", "Append", "None" if days is None else "ProcessingTime")


def changes(before: DataFrame, now: DataFrame, key: str, hash_: str, time: str, within: str = "3 days", late: str = "1 day") -> DataFrame:
    """key, change of every key of two runs: new, unchanged, changed, or vanished. Of streams, rows meet that come up to `within`
    apart; one that nothing met is given once the watermark, `late` behind the newest row, has passed it by. So a late row still
    meets its other, and one later than that is dropped, as the watermark is what bounds the state. Keys are unique in each run and
    not null."""
    old, new = (watermarked(df.select(F.col(key).alias(f"{p}key"), F.col(hash_).alias(f"{p}hash"), F.col(time).alias(f"{p}time")), f"{p}time", late) for df, p in ((before, "_a"), (now, "_b")))
    meets = (F.col("_akey") == F.col("_bkey")) & F.col("_btime").between(F.col("_atime"), F.col("_atime") + F.expr(f"INTERVAL {within}"))
    both = old.join(new, meets, "full_outer")
    change = F.when(F.col("_akey").isNull(), "new").when(F.col("_bkey").isNull(), "vanished").when(F.col("_ahash").eqNullSafe(F.col("_bhash")), "unchanged").otherwise("changed")
    return both.select(F.coalesce("_akey", "_bkey").alias(key), change.alias("change"))


def changed_since(now: DataFrame, before: DataFrame, key: str, hash_: str) -> DataFrame:
    """now's rows with change: new, unchanged or changed, against a run that is finished: a table, which a stream joins as it is."""
    known = before.select(F.col(key).alias("_key"), F.col(hash_).alias("_hash"))
    change = F.when(F.col("_key").isNull(), "new").when(F.col("_hash").eqNullSafe(F.col(hash_)), "unchanged").otherwise("changed")
    return now.join(known, F.col(key) == F.col("_key"), "left").withColumn("change", change).drop("_key", "_hash")


def visited(df: DataFrame, *keys: str) -> DataFrame:
    """The first row of each key, remembered for good: what a crawl doesn't fetch twice."""
    if df.isStreaming:
        df.sparkSession.conf.set(PROVIDER, ROCKSDB)
    return df.dropDuplicates(list(keys))


def state_of(spark: SparkSession, checkpoint: str, variable: str | None = None) -> DataFrame:
    """The keys that a stream's state holds, as its checkpoint has them, and the value where a variable of custom state is named."""
    reader = spark.read.format("statestore")
    if variable is not None:
        reader = reader.option("stateVarName", variable)
    rows = reader.load(checkpoint)
    return rows.select("key.*", *(["value.*"] if variable is not None else []))


def run_through(stream: DataFrame, target: str, checkpoint: str) -> None:
    """What a stream gives of all that there is, appended to a table of Parquet files; started again with its checkpoint, it goes on
    where it stopped, and no row comes twice."""
    shared_folder(stream.sparkSession)
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start().awaitTermination()
