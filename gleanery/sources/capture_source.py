"""Captures as a data source of Spark's: `spark.read.format("captures")` and `spark.readStream.format("captures")` over one folder.

A folder holds Parquet files below `batch=<n>/host=<name>/`, as `write_captures` leaves them. A file is a partition; a filter that names
hosts leaves out the others' files before anything is read; a stream's offset is the last batch it has seen, so it reads each file
once, whatever is added later. Files are read as Arrow batches. Folders are listed through Arrow's file systems: local and shared
paths, and those of HDFS and object stores that Arrow knows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from gleanery.functions import urls
from gleanery.sources.tables import CAPTURES

# Spark plans such sources in Python processes of its own, which don't see this package: what they run travels whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = f"{CAPTURES}, host string, batch int"
#: Of a host that is blank or null, as Spark names its folder.
NONE = "__HIVE_DEFAULT_PARTITION__"


def write_captures(captures: DataFrame, folder: str, batch: int, url: str = "url") -> None:
    """Captures as the files of a batch. A batch that is written again replaces what it wrote before."""
    rows = captures.withColumn("host", urls.host(url)).withColumn("batch", F.lit(batch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "host").parquet(folder)


class CaptureFile(InputPartition):
    def __init__(self, path: str, host: str, batch: int):
        self.path, self.host, self.batch = path, host, batch


def _files(folder: str) -> list[CaptureFile]:
    """All files of a folder, in the order of batches, hosts and names; unfinished ones, whose names begin with `_`, are none."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    found = []
    for info in system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)):
        parts = dict(x.split("=", 1) for x in info.path.split("/") if "=" in x)
        if info.type == fs.FileType.File and info.base_name.endswith(".parquet") and not any(x.startswith(("_", ".")) for x in info.path[len(at) :].split("/")) and {"batch", "host"} <= parts.keys():
            host = unquote(parts["host"])
            found.append(CaptureFile(info.path, "" if host == NONE else host, int(parts["batch"])))
    return sorted(found, key=lambda f: (f.batch, f.host, f.path))


def _read(folder: str, part: CaptureFile, names: Sequence[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    system = fs.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else fs.LocalFileSystem()
    with system.open_input_file(part.path) as f:
        file = pq.ParquetFile(f)
        here = [n for n in names if n in file.schema_arrow.names]
        for rows in file.iter_batches(256, columns=here):
            given = {"host": pa.array([part.host] * rows.num_rows), "batch": pa.array([part.batch] * rows.num_rows, pa.int32())}
            columns = [rows.column(n) if n in here else given[n] if n in given else pa.nulls(rows.num_rows) for n in names]
            yield pa.RecordBatch.from_arrays([c.cast(schema.field(n).type) for c, n in zip(columns, names, strict=True)], list(names))


class CaptureReader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.folder, self.names, self.schema = folder, schema.fieldNames(), to_arrow_schema(schema)
        self.hosts: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes filters on hosts; what else there is Spark applies to the rows."""
        for f in filters:
            named = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if named is not None and f.attribute == ("host",):
                self.hosts = named if self.hosts is None else self.hosts & named
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [f for f in _files(self.folder) if self.hosts is None or f.host in self.hosts]

    def read(self, partition: CaptureFile) -> Iterator[pa.RecordBatch]:
        return _read(self.folder, partition, self.names, self.schema) if partition is not None else iter(())


class CaptureStream(DataSourceStreamReader):
    """Offsets are batches; `batches` of them at most are read at a time."""

    def __init__(self, folder: str, schema: StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.folder, self.names, self.schema = folder, schema.fieldNames(), to_arrow_schema(schema)

    def initialOffset(self) -> dict:
        return {"batch": -1}

    def latestOffset(self) -> dict:
        return {"batch": max((f.batch for f in _files(self.folder)), default=-1)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [f for f in _files(self.folder) if start["batch"] < f.batch <= end["batch"]]

    def read(self, partition: CaptureFile) -> Iterator[pa.RecordBatch]:
        return _read(self.folder, partition, self.names, self.schema)


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return CaptureReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return CaptureStream(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)
