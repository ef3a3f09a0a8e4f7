"""Sources with one document far longer than the others."""

import pytest

from gleanery.llm import mixing

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("seed", range(3))
def test_short_documents_fill_the_gap_of_a_long_one(spark, seed):
    rows = [(0, "w " * 50_000, "e", "a", 1), *((i, "w " * (150 + i % 100), "e", "a", 1) for i in range(1, 400))]
    rows += [(1000 + i, "w " * 200, "e", "b", 1) for i in range(250 + 200 * seed)]
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    out = mixing.mix(df, seed=40 + seed).collect()
    sizes = {r[0]: len(r[1].split()) for r in rows}
    for ids in (range(1000), range(1000, 5000)):
        mine = [r for r in out if r.doc_id in ids]
        gap = mine[0].target - sum(r.taken for r in mine)
        epochs = int(mine[0].target // mine[0].source_size)
        unused = [sizes[r.doc_id] for r in mine if len(r.shards) == epochs]
        assert not any(abs(gap - n) < abs(gap) for n in unused), (gap, sorted(unused)[:3])
        assert abs(gap) <= 125
    copies = mixing.mixed(df, seed=40 + seed).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in copies} == {r.doc_id: len(r.shards) for r in out if r.shards}
