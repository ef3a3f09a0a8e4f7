"""Disguises of several forms in one address."""

import pytest

from gleanery.llm import pii


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("to joe (at) example dot com now", ["joe (at) example dot com"]),
        ("to joe@example dot com now", ["joe@example dot com"]),
        ("to joe@mail.example dot co dot uk now", ["joe@mail.example dot co dot uk"]),
        ("to joe at example [dot] com now", ["joe at example [dot] com"]),
        ("to joe at mail dot example (dot) com.", ["joe at mail dot example (dot) com"]),
        ("joe (dot) smith at example [dot] com", ["joe (dot) smith at example [dot] com"]),
        ("joe dot smith@example dot com", ["joe dot smith@example dot com"]),
        ("joe dot a (dot) smith [at] example.com", ["joe dot a (dot) smith [at] example.com"]),
        ("jоe arroba exаmple (punto) com", ["jоe arroba exаmple (punto) com"]),
        ("ip 192 dot 168 dot 1 dot 10 end", ["192 dot 168 dot 1 dot 10"]),
        ("ip 192.168 dot 1 [dot] 10 end", ["192.168 dot 1 [dot] 10"]),
        ("ip one nine two dot 168 dot one dot 10 end", ["one nine two dot 168 dot one dot 10"]),
        ("ip one nine two [dot] one six eight [dot] one [dot] one", ["one nine two [dot] one six eight [dot] one [dot] one"]),
        ("look at example.com, or at the dot; 300 dot 1 dot 1 dot 1", []),
        ("1 2 3.4.5 at one.two.three.four dot", []),
        ("user@host is at home", []),
    ],
)
def test_mixed_disguises(text, found):
    base, spans = pii.spans_of(text)
    assert set(base) <= set(spans)
    assert [text[a:b] for a, b, _ in spans if (a, b, _) not in base] == found
    assert not any(part in pii.redact(text, spans) for part in found)


def test_mixed_disguises_are_linear():
    import time

    began = time.time()
    for s in ("1 dot " * 50_000, "a@a dot " * 50_000, "a dot " * 50_000 + "a@b.c", " at a [dot] " * 30_000, "[dot] a at a." * 30_000, "one dot two " * 30_000):
        pii.spans_of(s)
    assert time.time() - began < 30


def disguised(rng):
    """An identifier, its kind, and how it is written: each part disguised by chance, one at least."""
    at = lambda: rng.choice([" (at) ", " [at] ", "(at)", " {arroba} ", "[@]"])
    dot = lambda: rng.choice([" (dot) ", "[dot]", " {punto} ", "[.]", "."])
    digit = lambda d: rng.choice([d, rng.choice(pii.DIGIT_WORDS[int(d)])])
    alike = {v: k for k, v in pii.LOOKALIKES.items()}
    if rng.random() < 0.5:
        name, *labels = ("".join(rng.choice("abcdefghkmnop") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(3, 4)))
        plain = name + "@" + ".".join(labels)
        written = "".join(alike.get(c, c) if rng.random() < 0.2 else c for c in name) + at() + labels[0] + "".join(dot() + x for x in labels[1:])
        return plain, "email", written
    digits = "".join(rng.choice("0123456789") for _ in range(rng.randint(10, 13)))
    written = " ".join(digit(d) for d in digits)
    return "+" + digits, "phone", "plus " + (written if any(c.isalpha() for c in written) else "zero" + written[1:])


def test_disguises_at_random():
    """What is written among other words is found whole, and reads as the identifier once rewritten."""
    import random

    rng = random.Random(6)
    for _ in range(400):
        plain, kind, written = disguised(rng)
        before, after = (" ".join(rng.choice(["river", "stone", "tree", "Über", "été"]) for _ in range(rng.randint(0, 5))) for _ in range(2))
        text = f"{before} {written}; {after}"
        spans = [(a, b) for a, b, k in pii.spans_of(text)[1] if k == kind]
        start = len(before) + 1
        assert spans == [(start, start + len(written))], (text, plain, [text[a:b] for a, b in spans])
