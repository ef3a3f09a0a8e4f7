"""Fill-in-the-middle transformation by a sparse checkpoint index.

A text is cut into a prefix, a middle and a suffix by code points, but is held as UTF-8, where the place of the n-th code point isn't
known. While its code points are counted, block by block, a checkpoint is recorded every `every` bytes: the byte offset, and the
code points before it. A cut then takes a binary search among the checkpoints and a scan of one block, whatever the text's length;
nothing is held for a code point.

Where a row is cut, and in which order its parts stand, come from a hash of its id: rows that repeat an id and a text give the same
row, and reruns agree. A null id hashes as the empty string. A text that is null counts as empty; it, and one that contains a mark,
stays as it is (`plain`), as the marks of the others must be found again. Every row gives one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm._common import map_slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes between checkpoints.
EVERY = 4_096
#: Bytes counted at a time.
RUN = 1 << 20


class Checkpoints:
    """A text's code points: their number, and where any of them begins."""

    def __init__(self, data: bytes, every: int = EVERY):
        self.data = np.frombuffer(data, np.uint8)
        self.every = every
        counts = [np.zeros(1, np.int64)]
        step = max(1, RUN // every) * every
        for at in range(0, len(self.data), step):
            begins = _begins(self.data[at : at + step])
            counts.append(np.add.reduceat(begins, np.arange(0, len(begins), every), dtype=np.int64))
        #: Code points that begin before each multiple of `every` bytes, and before the end.
        self.before = np.cumsum(np.concatenate(counts))

    def __len__(self) -> int:
        return int(self.before[-1])

    def byte(self, n: int) -> int:
        """Where the code point of number n begins; the end for the number of all."""
        if n >= len(self):
            return len(self.data)
        block = int(np.searchsorted(self.before, n, "right")) - 1
        at = block * self.every
        begins = np.flatnonzero(_begins(self.data[at : at + self.every]))
        return at + int(begins[n - self.before[block]])


def _begins(data: np.ndarray) -> np.ndarray:
    """Whether each byte begins a code point."""
    return (data & 0xC0) != 0x80


def draws(doc_id: int | None) -> tuple[int, ...]:
    """The first four groups of eight digits of a hash of an id, as numbers."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def transform(data: bytes, doc_id: int | None, rate: int = 90, spm: int = 20, every: int = EVERY) -> tuple[int, str, int | None, int | None, bytes]:
    """Number of code points, form, code points of the prefix and of the middle, and the text in that form. `rate` of a hundred are
    cut at all, and of those `spm` of a hundred have the suffix first."""
    index = Checkpoints(data, every)
    n = len(index)
    one, two, three, four = draws(doc_id)
    if not data or three % 100 >= rate or any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, data
    low, high = sorted((one % (n + 1), two % (n + 1)))
    a, b = index.byte(low), index.byte(high)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if four % 100 < spm:
        return n, "spm", low, high - low, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", low, high - low, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def transformed(df: DataFrame, rate: int = 90, spm: int = 20, every: int = EVERY) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row of df (doc_id, text)."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = rows.column(1).cast(pa.binary())
        found = [transform(t.as_py() or b"", i, rate, spm, every) for i, t in zip(rows.column(0).to_pylist(), texts, strict=True)]
        columns = list(zip(*found, strict=True))
        kinds = pa.int64(), pa.string(), pa.int64(), pa.int64()
        output = pa.array(columns[4], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False)), output], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return map_slices(df.select(F.col("doc_id").cast("long"), "text"), batch, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text of an output. Each mark stands in it once: the parts have none, and none arises where two parts meet."""
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))
    before, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    psm = F.concat(F.substring_index(F.substring_index(before, s, 1), p, -1), middle, F.substring_index(before, s, -1))
    spm = F.concat(F.substring_index(before, p, -1), middle, F.substring_index(F.substring_index(before, p, 1), s, -1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 for every row of df."""
    rows = transformed(df)
    hashed = [F.sha2(x.cast("binary"), 256).alias(name) for x, name in ((F.col("output"), "output_sha256"), (restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashed)


#: The same rows in SQL.
ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS b,
      CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS d FROM d),
f AS (SELECT *, least(a % (n + 1), b % (n + 1)) AS lo, greatest(a % (n + 1), b % (n + 1)) AS hi,
      CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, lo) AS pre, substr(t, lo + 1, hi - lo) AS mid, substr(t, hi + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
