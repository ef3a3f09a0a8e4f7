"""A corpus pipeline over documents: low quality out, one of each group of near copies, personal data masked, sources
mixed to their weights, texts encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet and reads it as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import copies, mixing, pii, quality, sentencepiece_codec
from gleanery.llm._common import table
from gleanery.llm.queries import vocabulary
from gleanery.session import shared_folder, ship_package


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    ship_package(spark)
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, of five-word shingles alike by 0.8 or more: the one of the smallest id."""
    ship_package(spark)
    return copies.representatives(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with marks in place of personal data."""
    ship_package(spark)
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ship_package(spark)
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, decoded and n_corrected for every row."""
    ship_package(spark)
    return sentencepiece_codec.encode_decode(docs, vocabulary())


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: SQL can express neither a trained network nor seeded draws; tests hold run() against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's table is deleted once the next one is written; the last one's, which the result reads, stays."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(at, before), True)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
