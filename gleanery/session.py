"""Session helpers: executors' access to this package, and the folder that all of them share."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="gleanery-"), "gleanery.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def spread(df: DataFrame) -> DataFrame:
    """A scan of Parquet, for work that costs far more than reading: dealt anew where it has so few row groups, which aren't split,
    that three quarters of the cores would idle. Else as it is. Tables of more splits than a few for each core aren't looked into;
    of others the footers are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    if splits > 4 * cores:
        return df
    return df.repartition(cores) if min(splits, _row_groups(df)) * 4 <= cores else df


def _row_groups(df: DataFrame) -> int:
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    found = 0
    for file in df.inputFiles():
        at = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(at)
        try:
            found += reader.getRowGroups().size()
        finally:
            reader.close()
    return found


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local one is made only where a local session names none, as in tests; on a cluster,
    whose machines don't share it, that raises."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gleanery-checkpoint-"))
    return context.getCheckpointDir()
