"""SentencePiece encoding and decoding for merge-type vocabularies, and token counts by a two-tier lookup.

A merge-type (BPE) vocabulary joins, again and again, the adjacent pair of symbols whose joint piece scores
highest, leftmost first. `MergeModel.merge` does so with an agenda: a heap of adjacent pairs ordered by score, in
which entries that a merge has made stale are skipped.

Texts are encoded in pre-tokens. A cut is exact where no piece spans it, and which cuts are is read off the
vocabulary when it is loaded: before a word mark, and between a letter and a non-letter, unless a piece spans such
a place, in which case whole texts go through the agenda. Pre-tokens repeat, so workers keep their ids.

Every pre-token that the agenda encodes is encoded by the sentencepiece library as well, all new ones of an Arrow
batch in one call; where they differ the library's ids are used and counted. The library decodes, and a text that
doesn't come back from its ids unchanged is encoded anew as a whole by the library and compared.

Null text counts as empty. The empty text has no ids but begin and end. Every row gives one row, in any order; null
and repeated doc_ids are kept as they are.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleanery.llm._common import map_batches

MARK = "▁"
#: Entries after which a worker's cache starts anew, and the characters of an entry at most: longer ones are forgotten after
#: their batch.
CACHE = 500_000
LONG = 64
#: Characters of a pre-token from which its agenda is held in arrays.
ARRAYS = 2_048


class MergeModel:
    """A merge-type vocabulary, read from a sentencepiece model's bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(sp.get_piece_size())
        special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.ids = {sp.id_to_piece(i): i for i in ids if i not in special}
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown, self.begin, self.end = sp.unk_id(), sp.bos_id(), sp.eos_id()
        self.bytes_fall_back = all(sp.is_byte(i) for i in self.byte_ids)
        # identity normalisation with a leading word mark is what the pre-tokens assume
        plain = sp.encode(" a  b ", out_type=str)
        # numerals such as superscripts are word characters to a pattern, but no letters
        numerals = re.escape("".join(sorted({c for p in self.ids for c in p if re.match(r"[^\W\d_]", c) and not c.isalpha()})))
        letters, others = rf"[^\W\d_{numerals}]", rf"(?:[^\w{MARK}]|[\d_{numerals}])"
        self.pattern = re.compile(rf"{MARK}+(?:{letters}+|{others}+)?|{letters}+|{others}+")
        self._letter = re.compile(letters).match
        self.cuts = "".join(plain) == f"{MARK}{MARK}a{MARK}{MARK}b{MARK}" and all(map(self._cut_safely, self.ids)) and not any("\n" in p for p in self.ids) and self.bytes_fall_back

    def _cut_safely(self, piece: str) -> bool:
        return not any((y == MARK and x != MARK) or (x != MARK and bool(self._letter(x)) != bool(self._letter(y))) for x, y in zip(piece, piece[1:], strict=False))

    def merge(self, text: str) -> list[int]:
        """Ids of a normalised text, by a score-ordered agenda of adjacent pairs."""
        if len(text) >= ARRAYS:
            return self._merge_in_arrays(text)
        symbols = list(text)
        last = len(symbols) - 1
        rank = self.rank
        if last > 0:
            agenda = []
            for i in range(last):
                pair = symbols[i] + symbols[i + 1]
                if pair in rank:
                    agenda.append((rank[pair], i, pair))
            if agenda:
                heapq.heapify(agenda)
                after = list(range(1, last + 2))
                before = list(range(-1, last))
                pop, push = heapq.heappop, heapq.heappush
                while agenda:
                    _, i, pair = pop(agenda)
                    left = symbols[i]
                    j = after[i]
                    if not left or j > last or len(left) + len(symbols[j]) != len(pair) or left + symbols[j] != pair:
                        continue
                    symbols[i], symbols[j] = pair, ""
                    after[i] = k = after[j]
                    if k <= last:
                        before[k] = i
                        joined = pair + symbols[k]
                        if joined in rank:
                            push(agenda, (rank[joined], i, joined))
                    h = before[i]
                    if h >= 0:
                        joined = symbols[h] + pair
                        if joined in rank:
                            push(agenda, (rank[joined], h, joined))
        out: list[int] = []
        for s in symbols:
            if s:
                if (found := self.ids.get(s)) is not None:
                    out.append(found)
                elif self.bytes_fall_back:
                    out.extend(self.byte_ids[b] for b in s.encode("utf-8"))
                else:
                    out.append(self.unknown)
        return out

    def _numbered(self) -> tuple[list[str], dict[str, int], dict[int, int], np.ndarray]:
        """Symbols that can be part of a merge, and their numbers: the pieces, by rank, then further characters of pieces; the
        piece that two symbols make, by their numbers; and each piece's place among the ranks."""
        if not hasattr(self, "_numbers"):
            symbols = sorted(self.ids, key=lambda p: (self.rank[p], p))
            symbols += sorted({c for p in symbols for c in p} - self.ids.keys())
            number = {s: i for i, s in enumerate(symbols)}
            made = {number[p[:i]] << 32 | number[p[i:]]: n for n, p in enumerate(symbols[: len(self.ids)]) for i in range(1, len(p)) if p[:i] in number and p[i:] in number}
            place = np.unique([self.rank[p] for p in symbols[: len(self.ids)]], return_inverse=True)[1]
            self._numbers = symbols, number, made, place
        return self._numbers

    def _merge_in_arrays(self, text: str) -> list[int]:
        """merge() of a long text: symbols are numbers in arrays, and the agenda is a heap of longs, each the place of a pair's
        score among all scores before the place in the text, so that a character takes some 50 bytes and not hundreds."""
        symbols, number, made, place = self._numbered()
        ranks = place.tolist()
        last = len(text) - 1
        at = array("q", (number.get(c, -1) for c in text))
        after, before = array("q", range(1, last + 2)), array("q", range(-1, last))
        agenda = [ranks[p] << 40 | i for i in range(last) if at[i] >= 0 <= at[i + 1] and (p := made.get(at[i] << 32 | at[i + 1])) is not None]
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        gone = -2
        while agenda:
            entry = pop(agenda)
            i = entry & 0xFFFFFFFFFF
            x, j = at[i], after[i]
            if x < 0 or j > last or at[j] < 0 or (pair := made.get(x << 32 | at[j])) is None or ranks[pair] != entry >> 40:
                continue
            at[i], at[j] = pair, gone
            after[i] = k = after[j]
            if k <= last:
                before[k] = i
                if at[k] >= 0 and (p := made.get(pair << 32 | at[k])) is not None:
                    push(agenda, ranks[p] << 40 | i)
            h = before[i]
            if h >= 0 and at[h] >= 0 and (p := made.get(at[h] << 32 | pair)) is not None:
                push(agenda, ranks[p] << 40 | h)
        out: list[int] = []
        for i, x in enumerate(at):
            if x >= 0 and (found := self.ids.get(symbols[x])) is not None:
                out.append(found)
            elif x != gone:
                out.extend([self.byte_ids[b] for b in text[i].encode("utf-8")] if self.bytes_fall_back else [self.unknown])
        return out

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text, with word marks for spaces; the empty text has none."""
        return self.pattern.findall(MARK + text.replace(" ", MARK)) if text else []

    def by_library(self, pre_tokens: list[str]) -> list[list[int]]:
        """The library's ids of pre-tokens. It puts a word mark before what it is given: taken off the pre-token where
        it begins with one, else held apart by a line feed, which is part of no piece."""
        marked = [x[0] == MARK for x in pre_tokens]
        got = self.library.encode([x[1:] if m else "\n" + x for x, m in zip(pre_tokens, marked, strict=True)], num_threads=1)
        only_mark = [self.ids[MARK]] if MARK in self.ids else []
        return [(g or only_mark) if m else g[2:] for g, m in zip(got, marked, strict=True)]


_models: dict[bytes, MergeModel] = {}


def model_of(data: bytes) -> MergeModel:
    """One model per worker process and vocabulary."""
    key = hashlib.sha256(data).digest()
    if key not in _models:
        _models[key] = MergeModel(data)
    return _models[key]


class _Chunks(dict):
    """Space-delimited chunks to their ids as little-endian bytes. Missing ones are encoded by pre-token; `fresh` holds
    pre-tokens that the library has still to confirm, `long` those too long to be kept beyond their batch."""

    def __init__(self, model: MergeModel):
        self.model, self.tokens, self.long, self.fresh = model, {}, {}, []

    def token(self, pre_token: str) -> bytes:
        held = self.tokens if len(pre_token) <= LONG else self.long
        if (found := held.get(pre_token)) is None:
            found = held[pre_token] = array("I", self.model.merge(pre_token)).tobytes()
            self.fresh.append(pre_token)
        return found

    def __missing__(self, chunk: str) -> bytes:
        out = b"".join(map(self.token, self.model.pattern.findall(MARK + chunk)))
        if len(chunk) <= LONG:
            self[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if MARK not in text and "" not in (chunks := text.split(" ")):
            return b"".join(map(self.__getitem__, chunks))
        return b"".join(map(self.token, self.model.pre_tokens(text)))

    def confirm(self) -> int:
        """Holds the fresh pre-tokens against the library, whose ids stand. Returns how many differed."""
        wrong = 0
        if self.fresh:
            for x, ids in zip(self.fresh, self.model.by_library(self.fresh), strict=True):
                held = self.tokens if len(x) <= LONG else self.long
                if (right := array("I", ids).tobytes()) != held[x]:
                    held[x], wrong = right, wrong + 1
            self.fresh = []
            if wrong:
                self.clear()
        return wrong

    def bound(self) -> None:
        self.long.clear()
        if len(self) > CACHE:
            self.clear()
        if len(self.tokens) > CACHE:
            self.tokens.clear()


_chunks: dict[int, _Chunks] = {}


def encode_batch(model: MergeModel, texts: list[str]) -> tuple[list[bytes], int]:
    """Ids of texts as little-endian unsigned 32-bit integers, without begin and end, and how many pre-tokens or whole
    texts the library corrected."""
    if not model.cuts:
        own = [model.merge(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        right = model.library.encode(texts, num_threads=1)
        return [array("I", x).tobytes() for x in right], sum(x != y for x, y in zip(own, right, strict=True))
    cache = _chunks.setdefault(id(model), _Chunks(model))
    cache.bound()
    out = list(map(cache.encode, texts))
    if wrong := cache.confirm():
        out = list(map(cache.encode, texts))
    return out, wrong


def encode_decode(df: DataFrame, model: bytes, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of df: id, ids (begin and end included), the decoded text, and how often the library
    corrected the agenda in its Arrow batch (0 where they agree, as they do)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(shared.value)
        edges = array("I", [m.begin]).tobytes(), array("I", [m.end]).tobytes()
        for rows in batches:
            for part, texts in _pieces(rows):
                blobs, _, decoded, wrong = _round_trip(m, texts)
                offsets = np.cumsum([0, *(len(b) // 4 + 2 for b in blobs)], dtype=np.int32)
                flat = np.frombuffer(b"".join(edges[0] + b + edges[1] for b in blobs), np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), ids, pa.array(decoded, pa.string()), pa.array([wrong] * len(texts), pa.int64())], ["doc_id", "ids", "decoded", "n_corrected"])

    return df.select(id_column, text_column).mapInArrow(run, "doc_id long, ids array<int>, decoded string, n_corrected long")


def _pieces(rows: pa.RecordBatch, characters: int = 1_000_000, most: int = 1 << 30) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch, of `most` rows, whose texts hold about so many characters: ids as Python lists are large."""
    start = 0
    while start < rows.num_rows:
        texts: list[str] = []
        size = 0
        while start + len(texts) < rows.num_rows and size < characters and len(texts) < most:
            texts.append(rows.column(1)[start + len(texts)].as_py() or "")
            size += len(texts[-1])
        yield rows.slice(start, len(texts)), texts
        start += len(texts)


def _round_trip(m: MergeModel, texts: list[str]) -> tuple[list[bytes], list[list[int]], list[str], int]:
    blobs, wrong = encode_batch(m, texts)
    ids = [[m.begin, *array("I", b), m.end] for b in blobs]
    decoded = m.library.decode(ids)
    odd = [i for i, (t, d) in enumerate(zip(texts, decoded, strict=True)) if t != d]
    for i, right in zip(odd, m.library.encode([texts[i] for i in odd], num_threads=1), strict=True):
        if [m.begin, *right, m.end] != ids[i]:
            ids[i], blobs[i], wrong = [m.begin, *right, m.end], array("I", right).tobytes(), wrong + 1
            decoded[i] = m.library.decode(ids[i])
    return blobs, ids, decoded, wrong


def digests(df: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_corrected: encode_decode's outputs, digested where they arise so
    that ids and texts don't travel."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        m = model_of(shared.value)
        out: tuple[list, ...] = ([], [], [], [])
        begin, end = array("I", [m.begin]).tobytes(), array("I", [m.end]).tobytes()
        for _, texts in _pieces(rows):
            blobs, _, decoded, wrong = _round_trip(m, texts)
            for b, d in zip(blobs, decoded, strict=True):
                out[0].append(len(b) // 4 + 2)
                out[1].append(hashlib.sha256(begin + b + end).hexdigest())
                out[2].append(hashlib.sha256(d.encode("utf-8")).hexdigest())
                out[3].append(wrong)
        return pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_corrected"])

    return map_batches(df.select("doc_id", "text"), batch, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_corrected long")


# Token counts


def frequent_words(df: DataFrame, keep: int = 16_384, fan_in: int = 100, levels: int = 3) -> list[str]:
    """The most frequent space-delimited words over every text, by mergeable counters: each task counts all of its texts and
    hands on `keep` words at most; `fan_in` counters at a time are merged into one such, level by level, and the last, one for
    a million tasks, on the driver. What travels are counters of bounded size, a row for each task, not pre-tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counter: Counter = Counter()
        for rows in batches:
            for t in rows.column(0):
                if t := t.as_py():
                    words = t.split(" ")
                    # words are short in the mean, or the long ones are left out before they are held
                    counter.update(words if len(t) <= LONG * len(words) else [x for x in words if len(x) <= LONG])
                if len(counter) > 20 * keep:
                    counter = Counter(dict(counter.most_common(10 * keep)))
        yield _counters(TaskContext.get().partitionId() // fan_in, counter, keep)

    def merged(rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_counters(rows.column("part")[0].as_py() // fan_in, _sum(rows), keep)])

    schema = "part int, words array<string>, counts array<long>"
    counters = df.select("text").mapInArrow(count, schema)
    for _ in range(levels):
        counters = counters.groupBy("part").applyInArrow(merged, schema)
    total: Counter = Counter()
    for row in counters.toLocalIterator():
        total.update(dict(zip(row.words, row.counts, strict=True)))
    return [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:keep]]


def _counters(part: int, counter: Counter, keep: int) -> pa.RecordBatch:
    top = sorted(((w, n) for w, n in counter.items() if len(w) <= LONG), key=lambda x: (-x[1], x[0]))[:keep]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([[w for w, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], ["part", "words", "counts"])


def _sum(rows: pa.Table) -> Counter:
    total: Counter = Counter()
    for words, counts in zip(rows.column("words"), rows.column("counts"), strict=True):
        total.update(dict(zip(words.as_py(), counts.as_py(), strict=True)))
    return total


class _Lengths(dict):
    """Second tier: lengths of chunks that the broadcast table lacks, kept by the worker; what is longer than LONG is kept for
    its run of texts only."""

    def __init__(self, model: MergeModel):
        self.model, self.tokens, self.long = model, {}, set()

    def learn(self, chunks: set[str]) -> None:
        parts = {c: self.model.pattern.findall(MARK + c) for c in chunks}
        new = list({p for x in parts.values() for p in x} - self.tokens.keys())
        self.long.update(x for x in (*chunks, *new) if len(x) > LONG)
        self.tokens.update(zip(new, map(len, self.model.by_library(new)), strict=True) if new else ())
        self.update((c, sum(map(self.tokens.__getitem__, x))) for c, x in parts.items())

    def bound(self) -> None:
        if len(self) > CACHE or len(self.tokens) > CACHE:
            self.clear()
            self.tokens.clear()
        for key in self.long:
            self.pop(key, None)
            self.tokens.pop(key, None)
        self.long.clear()


_lengths: dict[int, _Lengths] = {}
_tables: dict[bytes, dict[str, int]] = {}


def _packed(words: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, words.schema) as writer:
        writer.write_batch(words)
    return out.getvalue()


def _table_of(data: bytes) -> dict[str, int]:
    """The broadcast table, which travels as two packed columns, as a hash table: one for each worker."""
    if data not in _tables:
        _tables.clear()
        with pa.ipc.open_stream(data) as reader:
            words = reader.read_all()
        _tables[data] = dict(zip(words.column("word").to_pylist(), words.column("n").to_pylist(), strict=True))
    return _tables[data]


def count_tokens(df: DataFrame, model: bytes, limit: int = 4096, keep: int = 16_384) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row. First tier: a broadcast table of at most `keep` words and
    their lengths. Second tier: the worker's cache, filled by the library in one call for each run of texts. No
    pre-token is shuffled."""
    m = model_of(model)
    context = df.sparkSession.sparkContext
    first: dict[str, int] = {}
    if m.cuts:
        learner = _Lengths(m)
        learner.learn({w for w in frequent_words(df, keep) if w and MARK not in w})
        first = dict(learner)
    words = pa.RecordBatch.from_arrays([pa.array(list(first), pa.string()), pa.array(list(first.values()), pa.uint16())], ["word", "n"])
    shared, table = context.broadcast(model), context.broadcast(_packed(words))

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        m, first = model_of(shared.value), _table_of(table.value)
        counts: list[int] = []
        sizes: list[int] = []
        second = _lengths.setdefault(id(m), _Lengths(m))
        for _, texts in _pieces(rows, most=512):
            second.bound()
            counts += _counted(m, first, second, texts)
            sizes += [len(t.encode("utf-8")) for t in texts]
        return pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(df.select("doc_id", "text"), batch, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def _counted(m: MergeModel, first: dict[str, int], second: _Lengths, texts: list[str]) -> list[int]:
    out = [0] * len(texts)
    whole, parted = [], []
    for i, t in enumerate(texts):
        if t:
            if m.cuts and MARK not in t and "" not in (chunks := t.split(" ")):
                parted.append((i, chunks))
            else:
                whole.append(i)
    for i, ids in zip(whole, m.library.encode([texts[i] for i in whole], num_threads=1), strict=True):
        out[i] = len(ids)
    misses: set[str] = set()
    rest = []
    for i, chunks in parted:
        got = list(map(first.get, chunks))
        left = [c for c, n in zip(chunks, got, strict=True) if n is None] if None in got else []
        out[i] = sum(filter(None, got))
        misses.update(c for c in left if c not in second)
        rest.append((i, left))
    if misses:
        second.learn(misses)
    for i, left in rest:
        out[i] += sum(map(second.__getitem__, left))
    return out
