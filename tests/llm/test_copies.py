"""Near copies of 0.8 and more, against all pairs compared."""

import random

import numpy as np
import pytest

from gleanery.llm import copies
from tests.llm.test_operators import TWINS, plain_components

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_shingles(text):
    tokens = (text or "").lower().split()
    return {tuple(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))} if tokens else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def changed(words, n, rng):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.random()}"
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    out = []
    for k in range(60):  # k % 12 words of 300 changed: similarities from about 0.69 to 1
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        out += [" ".join(words), " ".join(changed(words, k % 12, rng))]
    words = [f"h{i}" for i in range(200)]
    out += [" ".join(words[: 200 - i]) for i in range(60)]  # a chain: ends unlike, neighbours alike
    return [*out, "", None, "a b", "A  b", "a c", out[0].upper()]


def test_all_of_similarity_stay_once(spark, texts):
    rows = [(i, t, "x", "x", len(t or "")) for i, t in enumerate(texts)]
    sets = [plain_shingles(t) for t in texts]
    roots = plain_components(list(range(len(texts))), lambda i, j: alike(sets[i], sets[j]))
    kept = copies.representatives(spark.createDataFrame(rows, KINDS).repartition(5)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(roots))
    assert all(tuple(r) == rows[r.doc_id] for r in kept)
    near = [(2 * k, 2 * k + 1) for k in range(60) if alike(sets[2 * k], sets[2 * k + 1])]
    assert len(near) > 30 and not {b for _, b in near} & {r.doc_id for r in kept}


def test_a_group_in_parts(spark, texts):
    """Groups cut into many cells give the same components."""
    rows = [(i, t, "x", "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    whole, cut, few = ({frozenset(m) for m in by_component(copies.groups(df, held=held, most=most).collect())} for held, most in ((copies.HELD, copies.MOST), (500, copies.MOST), (copies.HELD, 7)))
    assert whole == cut == few


def by_component(rows):
    out = {}
    for r in rows:
        out.setdefault(r.component, []).append(r.doc_id)
    return out.values()


def test_sets_and_fingerprints(texts):
    """Hashes are equal where shingles are, over all texts; and a fingerprint's bits are the majority's."""
    plain = [plain_shingles(t) for t in texts]
    sets = copies.shingle_sets(texts)
    assert [len(s) for s in sets] == [len(p) for p in plain]
    known = {}
    for p, s in zip(plain, sets, strict=True):
        assert known.setdefault(frozenset(p), s.tobytes()) == s.tobytes()
    assert len(set(known.values())) == len(known)
    assert len(np.unique(np.concatenate(sets))) == len(set().union(*plain))
    for s in sets[:5]:
        bits = sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in s) > len(s))
        assert copies.fingerprint_of(s) % 2**64 == bits
    assert [s.tolist() for s in copies.shingle_sets(texts[:7])] == [copies.shingles(t).tolist() for t in texts[:7]]


def test_pairs_share_keys_as_often_as_min_hashes_do(monkeypatch):
    """Of pairs of similarity 0.8 some 33% share one band; taken together or one by one the keys are the same."""
    rng = np.random.default_rng(3)
    pairs = []
    for _ in range(300):
        both = np.unique(rng.integers(0, 1 << 63, 180, np.uint64))
        a, b = both[:100], both[11:111]  # 89 of 111
        pairs += [np.sort(a), np.sort(b)]
    keys = copies.band_keys([np.zeros(0, np.uint64), *pairs])
    assert len(keys[0]) == 0 and all(len(k) == copies.BANDS for k in keys[1:])
    same = np.mean([(x == y).mean() for x, y in zip(keys[1::2], keys[2::2], strict=True)])
    assert abs(same - (89 / 111) ** copies.ROWS) < 0.02
    monkeypatch.setattr(copies, "RUN", 50)
    assert all((x == y).all() for x, y in zip(keys[1:], copies.band_keys(pairs), strict=True))


def test_repeated_ids_keep_different_texts(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    rows = [(1, one, "x", "x", 1), (1, two, "x", "x", 1), (1, one, "x", "x", 1), (1, one + " end", "y", "x", 1), (None, one, "x", "x", 1), (None, "lone", "x", "x", 1), (None, "lone", "x", "x", 1)]
    df = spark.createDataFrame(rows, KINDS)
    kept = copies.representatives(df.repartition(4)).collect()
    assert len(kept) == 3 and {r.doc_id for r in kept if r.text == two} == {1} and sum(r.text == "lone" for r in kept) == 1
    assert sorted(map(str, kept)) == sorted(map(str, copies.representatives(df.coalesce(1)).collect()))


def test_words_with_alike_sums_are_no_copies(spark):
    """Words that a sum of bytes times powers can't tell apart, alone and before eight words: similarities of 0 and 4/6."""
    ends = ["", " a b c d e f g h"]
    rows = [(i, w + end, "x", "x", 1) for i, (w, end) in enumerate((w, end) for end in ends for w in TWINS)]
    assert sorted(r.doc_id for r in copies.representatives(spark.createDataFrame(rows, KINDS)).collect()) == [0, 1, 2, 3]


def test_the_pipeline_takes_them(spark, texts):
    import corpus_pipeline

    rows = [(i, t, "x", "x", 1) for i, t in enumerate(texts[:40])]
    df = spark.createDataFrame(rows, KINDS)
    sets = [plain_shingles(t) for t in texts[:40]]
    roots = plain_components(list(range(40)), lambda i, j: alike(sets[i], sets[j]))
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()) == sorted(set(roots))
