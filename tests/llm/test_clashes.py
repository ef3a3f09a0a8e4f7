"""Extra columns of tables, by every name that the modules use themselves, change no operator's rows and no stage's."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleanery.llm import queries

DATA = "/root/testdata/sf0.001"
NAMES = "p u f h k fp row shard count w _n n a b id ids lang_pred score size taken target x y text_ name node root keys stratum word words line host token group m least rank part owner own query_id doc doc_id_ held_out length quality_ language".split()


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """The tables with clashing columns, of which one in two is null."""
    out = str(tmp_path_factory.mktemp("wide"))
    for t in ("documents", "labels", "embeddings", "pages"):
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        df = df.where("doc_id < 60") if t == "documents" else df.where("vec_id < 200") if t == "embeddings" else df
        df.write.parquet(f"{out}/plain/{t}.parquet")
        df.select("*", *(F.lit("x" if i % 2 else None).cast("string").alias(n) for i, n in enumerate(NAMES) if n not in df.columns)).write.parquet(f"{out}/wide/{t}.parquet")
    return out


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_operators(spark, wide, name):
    plain, clashing = (queries.QUERIES[name](spark, f"{wide}/{kind}") for kind in ("plain", "wide"))
    assert plain.columns == clashing.columns
    assert sorted(map(rounded, plain.collect())) == sorted(map(rounded, clashing.collect()))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, wide, name, stage):
    plain, clashing = (stage(spark, spark.read.parquet(f"{wide}/{kind}/documents.parquet"), f"{wide}/{kind}") for kind in ("plain", "wide"))
    assert plain.columns == clashing.columns
    assert sorted(map(rounded, plain.collect())) == sorted(map(rounded, clashing.collect()))


def rounded(row):
    return str([round(x, 4) if isinstance(x, float) else x for x in row])
