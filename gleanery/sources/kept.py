"""Tables that are made once and kept in the shared folder under a fingerprint of what they are made of, and read for as long as that
holds: merged runs that many reports start from, or what a crawl starts with. Changed inputs have another fingerprint, so nothing is
ever overwritten, and what two sessions make at the same time is the same.

A table may be clustered: dealt to buckets by its key columns and sorted there, so that windows, aggregates and joins on the key need
no shuffle.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from gleanery.session import shared_folder

#: Bytes of the inputs for each bucket.
BUCKET_BYTES = 128_000_000


def files_of(df: DataFrame) -> list[tuple[str, int, int]]:
    """Names, sizes and times of the files that a frame reads."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    out = []
    for name in sorted(df.inputFiles()):
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        status = at.getFileSystem(conf).getFileStatus(at)
        out.append((name, status.getLen(), status.getModificationTime()))
    return out


def fingerprint(*parts: object) -> str:
    return hashlib.sha256("\0".join(map(repr, parts)).encode()).hexdigest()[:32]


@cache
def _code() -> str:
    """Of this package but its training-data operators: tables that other code has made aren't this code's."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    digest = hashlib.sha256()
    for folder, below, names in os.walk(root):
        below[:] = sorted(b for b in below if b != "llm")
        for name in sorted(n for n in names if n.endswith(".py")):
            with open(os.path.join(folder, name), "rb") as f:
                digest.update(f.read())
    return digest.hexdigest()


def kept(spark: SparkSession, name: str, build: Callable[[], DataFrame], *inputs: object, keys: Sequence[str] = (), size: int = 0) -> DataFrame:
    """The table that build() gives, made now or before. `inputs` is what it depends on, as values that print the same when they are
    the same. With keys it is clustered by them; `size`, bytes of the inputs, says into how many buckets."""
    buckets = max(spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES)) if keys else 0
    table = f"kept_{name}_{fingerprint(inputs, tuple(keys), buckets, spark.version, _code())}"
    if keys and spark.catalog.tableExists(table):
        return spark.table(table)
    path = f"{shared_folder(spark).rstrip('/')}/kept/{table}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")):
        # written beside it and moved there whole: a half-written table is never read
        draft = f"{path}-{uuid.uuid4().hex}"
        rows = build()
        if keys:
            rows = rows.repartition(buckets, *keys)
            maker = f"draft_{uuid.uuid4().hex}"
            rows.write.format("parquet").option("path", draft).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(maker)
            spark.sql(f"DROP TABLE {maker}")
        else:
            rows.write.parquet(draft)
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(draft), at):
            fs.delete(jvm.org.apache.hadoop.fs.Path(draft), True)  # another was first
    found = spark.read.parquet(path)
    if not keys:
        return found
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    by = ", ".join(f"`{k}`" for k in keys)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)
