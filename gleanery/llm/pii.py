"""Personal data in texts, disguised or not, with offsets into the text as it is.

Base spans are plain patterns' leftmost matches, kind by kind, found in linear time whatever the text: e-mail addresses
from each at sign outwards, IPv4 addresses in chains of dotted numbers, cards and telephone numbers by patterns that
don't backtrack over what they have read.

Disguises are undone by a transducer: it rewrites homoglyphs, widths, invisible characters, spelled digits and at/dot
words, and notes for every rewritten stretch where it came from. Brackets are undone before plain words: those count where
another part of the address is clear, which is an at sign (in brackets or not), a dot in brackets, or for a plain at word a
dot word after it. Numbers are addresses where a dot between them is a word or stood in brackets. The same patterns run over
the rewritten text, and what they find is mapped back to the source characters. Such spans are added where a rewritten stretch
is part of them and no base span of their kind holds them already. Base spans stay as they are. Dot words are undone in names of
64 characters and domain labels of 63 at most, which is what addresses may have; base spans, and those that only brackets,
homoglyphs or digits disguise, may be of any length.

Null text counts as empty: no spans. Null and repeated doc_ids are kept.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gleanery.llm._common import map_batches

KINDS = ("email", "ip", "card", "phone")

Span = tuple[int, int, str]  # start, end (exclusive), kind

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            end = domain.end()
            out.append((start, end))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return out


def _addresses(text: str) -> list[tuple[int, int]]:
    out = []
    for chain in _CHAIN.finditer(text):
        parts = chain.group().split(".")
        start = chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            length = sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in four):
                out.append((start, start + length))
            start += length + 1
    return out


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m.group())) <= 15]


_FINDERS = {"email": _emails, "ip": _addresses, "card": _cards, "phone": _phones}


def find(text: str) -> list[Span]:
    """Base spans, by start, then kind as listed."""
    kinds = [k for k in KINDS if (k == "email" and "@" in text) or (k == "phone" and "+" in text)]
    if _DIGIT.search(text):
        kinds += ["ip", "card"]
    return _sorted((*s, k) for k in kinds for s in _FINDERS[k](text))


def _sorted(spans) -> list[Span]:
    return sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# Letters of other scripts that look like Latin ones, digit words, and words for at and dot.
LOOKALIKES = dict(zip("аеорсухіјѕԁһոցԛԝАВЕКМНОРСТХІЈЅαοινρτυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhngqwABEKMHOPCTXIJSaoivptukABEZHIKMNOPTYX", strict=True))
DIGIT_WORDS = (
    ("zero", "null", "zéro", "cero"),
    ("one", "eins", "un", "uno"),
    ("two", "zwei", "deux", "dos"),
    ("three", "drei", "trois", "tres"),
    ("four", "vier", "quatre", "cuatro"),
    ("five", "fünf", "cinq", "cinco"),
    ("six", "sechs", "six", "seis"),
    ("seven", "sieben", "sept", "siete"),
    ("eight", "acht", "huit", "ocho"),
    ("nine", "neun", "neuf", "nueve"),
)
AT_WORDS = ("at", "arroba", "arobase", "klammeraffe")
DOT_WORDS = ("dot", "punkt", "point", "punto")

_VALUE = {w: str(i) for i, row in enumerate(DIGIT_WORDS) for w in row}
_AT, _DOT = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_ODD = re.compile("[\xa0\xadɐ-\U0010ffff]")
_WORD = "|".join(sorted(_VALUE, key=len, reverse=True))
_ONE = rf"(?:(?:{_WORD})(?![^\W\d_])|[0-9](?![0-9]))"
_SPELLED = re.compile(rf"(?<!\w)(?:plus[ -]{{1,3}})?{_ONE}(?:[ ,-]{{1,3}}(?:(?:{_DOT})[ -]{{1,3}})?{_ONE}){{3,}}", re.I)
_SPELLED_PART = re.compile(rf"(?P<plus>plus)|(?P<dot>{_DOT})|(?P<word>{_WORD})|(?P<digit>[0-9])|[ ,-]+", re.I)
_SPACED_WORDS = tuple(w + c for w in _VALUE for c in " -,")
_BRACKETED = re.compile(rf" {{0,2}}[\[({{<] {{0,2}}(?:(?P<at>{_AT}|@)|(?P<dot>{_DOT}|\.)) {{0,2}}[\])}}>] {{0,2}}", re.I)
_LABELS = rf"[A-Za-z0-9-]{{1,63}}(?:(?:\.| (?:{_DOT}) )[A-Za-z0-9-]{{1,63}})+"
_PLAIN_AT = re.compile(rf"(?<=[A-Za-z0-9_%+-]) (?P<at>{_AT}) (?=(?P<rest>{_LABELS}))", re.I)
_AT_SIGN = re.compile(rf"(?<=[A-Za-z0-9_%+-])@(?=(?P<rest>{_LABELS}))", re.I)
_PLAIN_DOT = re.compile(rf" (?:{_DOT}) ", re.I)
_NAME_DOT = re.compile(rf" (?:{_DOT}) (?=[A-Za-z0-9._%+-]{{1,64}}$)", re.I)
_NUMBER = rf"(?:[0-9]{{1,3}}(?![0-9])|(?:{_WORD})(?:[ -]{{1,3}}(?:{_WORD})){{0,2}}(?![^\W_]))"
_DOTTED = re.compile(rf"(?<![\w.]){_NUMBER}(?:(?:\.| {{1,3}}(?:{_DOT}) {{1,3}}){_NUMBER}){{3,}}", re.I)

Edit = tuple[int, int, str]  # start, end, what stands there instead


def _folded(c: str) -> str | None:
    """What a single odd character stands for; None: itself."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    kind = unicodedata.category(c)
    if kind == "Cf":
        return ""
    if kind == "Zs":
        return " "
    if kind == "Pd":
        return "-"
    if kind == "Nd":
        return str(unicodedata.digit(c))
    plain = unicodedata.normalize("NFKC", c)
    return plain if plain != c and len(plain) == 1 and plain.isascii() else "." if c in "。․" else None


def _characters(text: str) -> list[Edit]:
    return [(m.start(), m.end(), new) for m in _ODD.finditer(text) if (new := _folded(m.group())) is not None]


def _brackets(text: str) -> list[Edit]:
    if "[" in text or "(" in text or "{" in text or "<" in text:
        return [(m.start(), m.end(), "@" if m["at"] else ".") for m in _BRACKETED.finditer(text)]
    return []


def _words(text: str, bare: list[int]) -> list[Edit]:
    """bare: where dots stand that were in brackets, in order."""
    out: list[Edit] = []
    low = text.lower()
    dotted = any(f" {w} " in low for w in DOT_WORDS)

    def cleared(start: int, end: int) -> bool:
        return bisect_left(bare, start) < bisect_left(bare, end)

    if dotted or bare:
        ats = [(m, "@") for m in _PLAIN_AT.finditer(text) if _PLAIN_DOT.search(m["rest"]) or cleared(*m.span("rest"))] if any(f" {w} " in low for w in AT_WORDS) else []
        ats += [(m, None) for m in _AT_SIGN.finditer(text)] if dotted and "@" in text else []
        for m, new in ats:
            if new:
                out.append((m.start(), m.end(), new))
            out += [(d.start(), d.end(), ".") for d in _PLAIN_DOT.finditer(text, *m.span("rest"))]
            # the name may hold dots in words too
            start = m.start()
            while d := _NAME_DOT.search(text[max(0, start - 80) : start]):
                at = max(0, start - 80) + d.start()
                out.append((at, at + len(d.group()), "."))
                start = at
        for m in _DOTTED.finditer(text):
            if _PLAIN_DOT.search(m.group()) or cleared(*m.span()):
                out += _digits(text, *m.span())
    if sum(map(low.count, _SPACED_WORDS)) > 0:
        for m in _SPELLED.finditer(text):
            out += _digits(text, *m.span())
    kept: list[Edit] = []
    for edit in sorted(out):
        if not kept or edit[0] >= kept[-1][1]:
            kept.append(edit)
    return kept


def _digits(text: str, start: int, end: int) -> Iterator[Edit]:
    for part in _SPELLED_PART.finditer(text, start, end):
        new = "+" if part["plus"] else "." if part["dot"] else _VALUE.get(part["word"].lower(), "") if part["word"] else part["digit"] or ""
        if new != part.group():
            yield part.start(), part.end(), new


class Rewritten:
    """A text after edits, with the way back."""

    def __init__(self, text: str, edits: list[Edit]):
        self.at, self.source, self.edited = [], [], []  # starts here, spans there, whether rewritten
        parts, here, done = [], 0, 0
        for start, end, new in [*edits, (len(text), len(text), "")]:
            for a, b, s, changed in ((done, start, text[done:start], False), (start, end, new, True)):
                if s:
                    self.at.append(here)
                    self.source.append((a, b))
                    self.edited.append(changed)
                    parts.append(s)
                    here += len(s)
            done = end
        self.text = "".join(parts)

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of a span of the rewritten text, and whether any of it was rewritten."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        a = self.source[i][0] + (0 if self.edited[i] else start - self.at[i])
        b = self.source[j][1] if self.edited[j] else self.source[j][0] + end - self.at[j]
        # edits that left nothing lie between stretches
        gaps = any(self.source[k][1] != self.source[k + 1][0] for k in range(i, j))
        return a, b, gaps or any(self.edited[i : j + 1])


def find_disguised(text: str, base: list[Span]) -> list[Span]:
    """Spans that show only after rewriting."""
    first = Rewritten(text, _characters(text))
    middle = Rewritten(first.text, _brackets(first.text))
    bare = [at for at, changed in zip(middle.at, middle.edited, strict=True) if changed and middle.text[at] == "."]
    second = Rewritten(middle.text, _words(middle.text, bare))
    if second.text == text:
        return []
    out = []
    for start, end, kind in find(second.text):
        a, b, changed = second.back(start, end)
        a, b, cleared = middle.back(a, b)
        a, b, before = first.back(a, b)
        while a < b and text[b - 1] == " ":
            b -= 1
        while a < b and text[a] == " ":
            a += 1
        if (changed or cleared or before) and not any(k == kind and s <= a and b <= e for s, e, k in base):
            out.append((a, b, kind))
    return out


def spans_of(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans; all spans."""
    base = find(text)
    return base, _sorted([*base, *find_disguised(text, base)])


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with a mark such as [EMAIL] for each span; for spans that overlap, one mark, of the first."""
    out, done, n = [], 0, len(spans)
    i = 0
    while i < n:
        start, end, kind = spans[i]
        i += 1
        while i < n and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[done:start], f"[{kind.upper()}]"]
        done = end
    return "".join([*out, text[done:]])


def detect(df: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added for every row."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [], [], [], [])
        for text in rows.column(1).to_pylist():
            base, spans = spans_of(text or "")
            kinds = [k for _, _, k in base]
            for column, value in zip(out, (*map(kinds.count, KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans) - len(base)), strict=True):
                column.append(value)
        kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return map_batches(df.select("doc_id", "text"), batch, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(df: DataFrame) -> DataFrame:
    """documents with every span, disguised ones too, replaced by its mark; n_chars follows. A null text stays null."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t and redact(t, spans_of(t)[1]) for t in rows.column("text").to_pylist()]
        sizes = [n if t is None else len(t) for t, n in zip(texts, rows.column("n_chars").to_pylist(), strict=True)]
        for name, values in (("text", pa.array(texts, pa.string())), ("n_chars", pa.array(sizes, pa.int64()))):
            rows = rows.set_column(rows.schema.names.index(name), name, values)
        return rows

    kept = df.select("doc_id", "text", "lang", "source", "n_chars")
    return map_batches(kept, batch, "doc_id long, text string, lang string, source string, n_chars long")
