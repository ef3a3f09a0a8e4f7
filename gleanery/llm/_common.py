"""What the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.frames import looked_up
from gleanery.session import shared_folder, ship_package, spread

__all__ = ["checkpointed", "encoded", "fold", "looked_up", "map_batches", "map_slices", "sliced", "table", "text_bytes", "words"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's; texts are dealt to all cores where their file isn't."""
    ship_package(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8")


def words(text: str | None) -> list[bytes]:
    """The runs of `[^\\x20\\x09-\\x0D]+`, as UTF-8. bytes.split() parts at exactly these six bytes."""
    return encoded(text).split()


def fold(column, parts: int, keep: int):
    """Whether crc32 of the id as text leaves the remainder `keep`. A null id counts as the empty string."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts == keep


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with one output batch for each input batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with files in the shared folder; it survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column over all rows: one number, for choosing how many groups to deal the work to."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])


def sliced(batch: pa.RecordBatch, column: int = 1, size: int = 4_000_000, rows: int = 4_096) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `size` bytes of a text column, and of `rows` rows, at most; one row at least."""
    lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + size, "right"))
        upto = max(at + 1, min(upto, at + rows))
        yield batch.slice(at, upto - at)
        at = upto


def map_slices(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, size: int = 4_000_000) -> DataFrame:
    """mapInArrow with one output batch for each slice of an input batch; the text is its second column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in sliced(batch, size=size):
                yield function(rows)

    return df.mapInArrow(run, schema)
