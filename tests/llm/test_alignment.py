"""Alignment of two tokenizers against byte-by-byte brute force over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from gleanery.llm import alignment, queries
from tests.llm.test_operators import made

A, B = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")
HOSTILE = ["<|endoftext|> in <s> text </s>", "a  b", " a", "a ", "a\n b", "a\n \nb", "a \n\n b　c 　d", "▁ a▁b", "it's 'tis don't", "x y\x1cz\x85", "naïve 漢字 😀😀 ‍", "\0 nul", "à é", "１２ ½ ²", "\t", "  ", "\n\n\n", "ab" * 3000, "<0x41> <unk>", "a\n", "\na", "a \n b", "日本語 と 한국어", "﻿bom", "a\r\nb \r\n c"]


def whole_text(pair, text):
    """Groups and linked pairs by marking bytes."""
    ids_a, ids_b = pair.encode([text])[0]
    want = b" " + text.encode()
    a = [pair.bytes_a[i] for i in ids_a]
    b = [pair.bytes_b[i] for i in ids_b]
    if not text or b"".join(a) != want or b"".join(b) != want:
        return None
    of_a, of_b = (np.repeat(np.arange(len(x)), [len(t) for t in x]) for x in (a, b))
    links = Counter((ids_a[i], ids_b[j]) for i, j in set(zip(of_a.tolist(), of_b.tolist(), strict=True)))
    groups, x, y = [], [], []
    for at in range(len(want)):
        if not x or x[-1] != of_a[at]:
            x.append(of_a[at])
        if not y or y[-1] != of_b[at]:
            y.append(of_b[at])
        if at + 1 == len(want) or (of_a[at] != of_a[at + 1] and of_b[at] != of_b[at + 1]):
            groups.append(f"{','.join(str(ids_a[i]) for i in x)}|{','.join(str(ids_b[j]) for j in y)}")
            x, y = [], []
    return len(ids_a), len(ids_b), ";".join(groups), links


def brute(rows):
    pair = alignment.Pair(A, B)
    each = [(i, whole_text(pair, t or "")) for i, t in rows]
    documents = Counter(p for _, x in each if x for p in x[3])
    best = defaultdict(int)
    for (a, _), n in documents.items():
        best[a] = max(best[a], n)
    out = Counter()
    for i, x in each:
        if x is None:
            out[i, 0, 0, 0, 0, 0, 0, ""] += 1
        else:
            links = x[3]
            out[i, x[0], x[1], x[2].count(";") + 1, links.total(), sum(n for p, n in links.items() if documents[p] == best[p[0]]), sum(n * documents[p] for p, n in links.items()), hashlib.sha256(x[2].encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("sizes", [{}, {"keep": 40, "held": 500}, {"keep": 0, "held": 1}])
def test_alignment(spark, sizes):
    rows = [*made(40), *((1000 + i, t) for i, t in enumerate(HOSTILE))]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, pairs string").repartition(5)
    got = Counter(tuple(r) for r in alignment.digests(df, A, B, **sizes).collect())
    assert got == brute(rows)
    assert sum(n == 0 for _, n, *_ in got) < 20


def test_stretches_are_whole_texts(monkeypatch):
    """Texts by stretches give what whole texts do, with caches that overflow too."""
    rng = random.Random(5)
    pieces = ["a", "the", " ", "  ", "\n", "'s", "1", "é", "▁", "　", ".", "Über", "\x1c", "漢", "\t", "--", "x" * 70]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(1500)] + HOSTILE
    pair = alignment.Pair(A, B)
    for cache, together in ((alignment.CACHE, alignment.TOGETHER), (50, 3)):
        monkeypatch.setattr(alignment, "CACHE", cache)
        monkeypatch.setattr(alignment, "TOGETHER", together)
        aligner = alignment.Aligner(pair)
        for at in range(0, len(texts), 100):
            part = texts[at : at + 100]
            for t, got in zip(part, aligner.texts(part), strict=True):
                want = whole_text(pair, t)
                links = Counter((int(p) >> 32, int(p) & 0xFFFFFFFF) for p in np.frombuffer(got[4], np.uint64))
                assert (got[0], got[1], got[3], links) == (want if want else (0, 0, "", Counter())), repr(t)


def test_frequent_pairs_are_bounded(spark):
    counts = spark.createDataFrame([(i, 1 + i % 9) for i in range(90)], "pair long, n long")
    for keep in (0, 5, 20, 60, 90, 1000):
        least = alignment.frequent_from(counts, keep)
        assert counts.where(f"n >= {least}").count() <= keep and (least == 1 or counts.where(f"n >= {least // 2}").count() > keep)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.digests(df, A, B).collect() == []
