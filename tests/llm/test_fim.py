"""Cuts and outputs against plain slicing of code points."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest

from gleanery.llm import fim
from tests.llm.test_operators import made


def plain(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(t)
    low, high = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = t[:low], t[low:high], t[high:]
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        form, out = "plain", t
    elif h4 % 100 < 20:
        form, out = "spm", f"<S>{s}<P>{p}<M>{m}"
    else:
        form, out = "psm", f"<P>{p}<S>{s}<M>{m}"
    lengths = (None, None) if form == "plain" else (len(p), len(m))
    return (doc_id, n, form, *lengths, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    odd = ["<P>", "a<S>b", "<M", "<", "<P", "x<", "<<>", "S>", "<P<S<M", "é" * 10_000, "😀" * 3_001, "\0", "漢字\n" * 2_000]
    near = ["".join(rng.choice("<PSM>é") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    return [*made(40), *((500 + i, t) for i, t in enumerate([*odd, *near])), (None, "<"), (500, "<P>")]


def test_rows(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, form string, n int").repartition(4)
    got = Counter(tuple(r) for r in fim.digests(df).collect())
    assert got == Counter(plain(*r) for r in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_rows_equal_sql(spark, rows):
    documents = spark.createDataFrame(rows, "doc_id long, text string").toPandas().astype({"doc_id": "Int64"})
    assert len(documents) == len(rows)
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(fim.ORACLE)
    got = fim.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    assert want.columns == got.columns
    assert Counter(map(repr, want.fetchall())) == Counter(repr(tuple(r)) for r in got.collect())


@pytest.mark.parametrize("every", [1, 2, 7, 64, 4096])
def test_checkpoints(monkeypatch, every):
    monkeypatch.setattr(fim, "RUN", 100)
    rng = random.Random(every)
    for size in (0, 1, 6, 7, 8, 63, 64, 65, 900):
        text = "".join(rng.choice("aé漢😀\n") for _ in range(size))
        index = fim.Checkpoints(text.encode(), every)
        assert len(index) == size and len(index.before) == 1 + -(-len(text.encode()) // every)
        assert [index.byte(n) for n in range(size + 1)] == [len(text[:n].encode()) for n in range(size + 1)]


def test_no_rows(spark):
    assert fim.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
