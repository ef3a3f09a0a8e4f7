"""Base rules and the verdict by lines against plain loops."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from gleanery.llm import line_rules
from gleanery.llm._common import looked_up
from tests.llm.test_operators import made

WORD = re.compile("[^\x20\x09-\x0d]+")
KINDS = "doc_id long, text string, source string, host string, one long, line string, n int"


@pytest.fixture(scope="module")
def rows():
    """Hosts of many and few documents, null among them, with shared lines, copies, and lines repeated within a document."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    out = [(i, t, ("a", "b", None)[(i or 0) % 3]) for i, t in made(50)]
    for i in range(240):
        own = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(rng.randint(1, 4))]
        shared = rng.sample(["Menu  of THE site", "menu of the site", "All rights\treserved #1", "rare line"], rng.randint(0, 3)) if i % 3 else []
        lines = own + shared + (own[:1] if i % 5 == 0 else [])
        rng.shuffle(lines)
        out.append((1000 + i, rng.choice(["\n", "\n\n", "\n \n"]).join(lines), ("big", "big", "small", None)[i % 4]))
    out += [(2000 + i, "copy of one text\nthat is not rare\n" + " ".join(words), "big") for i in range(120)]
    out += [(2500 + i, "menu of the site\n" + f"few words {i}", "big") for i in range(30)]
    out += [(3000, "a " * 7, "a"), (3001, "a " * 8, "a"), (3002, "a " * 9, "a"), (3003, "a b c d e f g h " * 2 + "z " * 20, "a"), (3004, "1 2 3 4 5 6 7 8 9 x 1 2 3 4 5 6 7 8 9", "a"), (3005, "\n\n \n\t", None), (3006, "#$ | é # <&>", "a")]
    return out


def plain(rows):
    docs = [(i, t or "", s) for i, t, s in rows]
    hosts, held = defaultdict(set), defaultdict(set)
    for _, t, s in docs:
        hosts[s].add(t)
        for x in t.split("\n"):
            if WORD.search(x):
                held[s, normal(x)].add(t)
    often = {k for k, v in held.items() if len(v) > line_rules.LEAST and len(v) > line_rules.SHARE * len(hosts[k[0]])}
    out = Counter()
    for i, t, s in docs:
        w = WORD.findall(t)
        seen, places = defaultdict(list), set()
        for k in range(len(w) - 7):
            seen[tuple(w[k : k + 8])].append(k)
        for v in seen.values():
            if len(v) > 1:
                places |= {k + j for k in v for j in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        gone = sum(len(WORD.findall(x)) for x in lines if (s, normal(x)) in often)
        failed = len(w) < 20 or 100 * len(places) > 30 * len(w)
        kept = not failed and len(w) - gone >= 20 and len(w) - gone >= line_rules.LEFT * len(w)
        out[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(places), gone, failed, kept] += 1
    return out, often


def normal(line):
    return " ".join(WORD.findall(line)).lower()


def test_rows(spark, rows):
    df = spark.createDataFrame([(*r, "h", 1, "l", 2) for r in rows], KINDS).repartition(4)
    want, often = plain(rows)
    got = line_rules.rules(df, F.col("source"))
    assert Counter(tuple(r) for r in got.collect()) == want
    assert len({k for k, _ in often}) >= 2 and {r[7:] for r in want} == {(True, False), (False, True), (False, False)}


def test_rows_equal_sql(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    want, got = con.sql(line_rules.ORACLE), line_rules.rules(df, F.col("source"))
    assert want.columns == got.columns
    assert Counter(map(repr, want.fetchall())) == Counter(repr(tuple(r)) for r in got.collect())


def test_kept_documents_lose_frequent_lines(spark, rows):
    df = spark.createDataFrame([(*r, "h", 1, "l", 2) for r in rows], KINDS).repartition(4)
    kept, often = plain(rows)
    kept = {(r[0], r[1] - r[6]) for r in kept if r[8]}
    got = line_rules.cleaned(df, F.col("source")).collect()
    assert {(r.doc_id, len(WORD.findall(r.text))) for r in got} == kept and got[0].asDict().keys() == set(df.columns)
    texts = {(i, t): s for i, t, s in rows}
    assert all((r.source, normal(x)) not in often for r in got for x in r.text.split("\n"))
    assert sum((r.doc_id, r.text) not in texts for r in got) > 10


def test_no_python(spark, rows):
    """Nothing of the plan leaves the JVM."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plans = [line_rules.measured(df, F.col("source")), line_rules.rules(df, F.col("source"))]
    assert not any(word in d._jdf.queryExecution().toString() for d in plans for word in ("Python", "Arrow", "Pandas"))


def test_lookups_of_hot_keys(spark):
    """Keys of a third of the rows and of one, by broadcast and by shuffle, with the same rows as a join."""
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 3000), (2, 2), (3, 1), (4, 50)) for i in range(n)], "k int, x int")
    table = spark.createDataFrame([(1, 3000, "a"), (2, 2, "b"), (3, 1, "c"), (9, 1, "d")], "k int, n long, v string")
    for share in (1, 2, 1000, 10**9):
        got = looked_up(rows, table, ["k"], "n", share)
        assert Counter(map(tuple, got.select("k", "x", "v").collect())) == Counter(map(tuple, rows.join(table, "k").select("k", "x", "v").collect()))


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert line_rules.rules(df, F.col("source")).collect() == [] == line_rules.cleaned(df, F.col("source")).collect()
