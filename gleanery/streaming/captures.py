"""Captures as they come: rates in event-time windows, sessions of each host, first-wins deduplication, and per-host state.
The same functions take a batch or a stream; a stream needs a watermark, which bounds its state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.session import shared_folder


def watermarked(df: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    return df.withWatermark(time, late) if df.isStreaming else df


def tumbling(df: DataFrame, time: str, size: str, *by: str) -> DataFrame:
    rows = watermarked(df, time).groupBy(F.window(time, size).alias("w"), *by).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), *by, "n")


def sliding(df: DataFrame, time: str, size: str, step: str, *by: str) -> DataFrame:
    rows = watermarked(df, time).groupBy(F.window(time, size, step).alias("w"), *by).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), *by, "n")


def sessions(df: DataFrame, time: str, gap: str, by: str) -> DataFrame:
    rows = watermarked(df, time).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return rows.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(df: DataFrame, time: str, *keys: str) -> DataFrame:
    """The first row of each key. Of a stream the first that came within the watermark, which bounds what is remembered; of a batch
    the one of the least time, of those of one time the one whose columns are least."""
    if df.isStreaming:
        return watermarked(df, time).dropDuplicatesWithinWatermark(list(keys))
    rest = [c for c in df.columns if c != time and c not in keys]
    first = df.groupBy(*keys).agg(F.min(F.struct(time, *rest)).alias("_x"))
    return first.select(*(F.col(c) if c in keys else F.col(f"_x.`{c}`").alias(c) for c in df.columns))


def host_state(stream: DataFrame, host: str, status: str, time: str, late: str = "1 hour", idle: str = "6 hours") -> DataFrame:
    """Of each host, so far: captures, failures (status from 400) and failures in a row, updated with every batch. Custom state; a
    host of which nothing came for `idle` of event time beyond the watermark is forgotten, so that state doesn't grow with all
    hosts ever seen."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    quiet = pd.Timedelta(idle)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, failed, row, last = state.get if state.exists else (0, 0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        for bad in (rows[status].astype("float64") >= 400).tolist():
            n, failed, row = n + 1, failed + bad, row + 1 if bad else 0
        last = max(last, int(rows[time].max().timestamp() * 1000))
        state.update((n, failed, row, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + int(quiet.total_seconds() * 1000) + 1)
        yield pd.DataFrame({"host": [key[0]], "n": [n], "failed": [failed], "in_a_row": [row]})

    timed = watermarked(stream, time, late)
    return timed.groupBy(F.col(host).alias("host")).applyInPandasWithState(update, "host string, n long, failed long, in_a_row long", "n long, failed long, in_a_row long, last long", "update", GroupStateTimeout.EventTimeTimeout)


def run_to_end(df: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream over finished input gives, as a batch: through a memory table, for tests and small replays. Its checkpoint
    lies in the shared folder and is deleted after."""
    name = f"stream_{uuid.uuid4().hex}"
    folder = f"{shared_folder(df.sparkSession)}/{name}"
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", folder).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
    return df.sparkSession.table(name)


def ingest(source: DataFrame, target: str, checkpoint: str, by: str | None = "run", mode: str = "append") -> None:
    """Appends a stream of rows to Parquet below target/<by>=.../batch=N. A batch that is repeated after a failure has the same
    number, and replaces what it wrote before: every row comes once. The stream's checkpoint is where a stopped ingestion goes
    on."""

    def write(df: DataFrame, number: int) -> None:
        rows = df.withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*([by] if by else []), "batch").parquet(target)

    source.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
