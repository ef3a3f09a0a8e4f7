"""The pipeline on the smallest tables, and its stages against plain versions."""

from collections import Counter

import corpus_pipeline
import pytest

from gleanery.llm import pii, quality, queries
from gleanery.llm import sentencepiece_codec as codec

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    return out


def test_quality_keeps_what_the_classifier_accepts(spark, stages):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scored = quality.classify(spark.read.parquet(f"{DATA}/documents.parquet"), labels).collect()
    assert 0 < len(stages[1]) < len(stages[0])
    assert sorted(r.doc_id for r in stages[1]) == sorted(r.doc_id for r in scored if r.predicted)


def test_one_of_each_group_stays(spark, stages):
    """Five-word shingles alike by 0.8 or more."""
    from tests.llm.test_copies import alike, plain_shingles
    from tests.llm.test_operators import plain_components

    sets = [plain_shingles(r.text) for r in stages[1]]
    roots = plain_components([r.doc_id for r in stages[1]], lambda i, j: alike(sets[i], sets[j]))
    assert sorted(r.doc_id for r in stages[2]) == sorted(set(roots))
    assert len(stages[2]) < len(stages[1])


def test_personal_data_is_masked(stages):
    was = {r.doc_id: r for r in stages[2]}
    assert len(stages[3]) == len(was)
    for r in stages[3]:
        text = was[r.doc_id].text
        assert r.text == pii.redact(text, pii.spans_of(text)[1]) and r.n_chars == len(r.text)
        assert not pii.find(r.text)


def test_the_mix_repeats_whole_documents(stages):
    rows = {r.doc_id: r for r in stages[3]}
    assert all(r == rows[r.doc_id] for r in stages[4])
    assert max(Counter(r.doc_id for r in stages[4]).values()) <= 3


def test_encoding(stages):
    sp = codec.model_of(queries.vocabulary()).library
    texts = Counter((r.doc_id, r.text) for r in stages[4])
    assert Counter((r.doc_id, r.decoded) for r in stages[5]) == texts
    assert all(list(r.ids) == [1, *sp.encode(r.decoded), 2] for r in stages[5])


def test_run_agrees_with_its_stages(spark, stages):
    assert Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, DATA).collect()) == Counter((r.doc_id, tuple(r.ids)) for r in stages[5])


def test_every_query_is_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
