"""Quality rules by what lines do across documents, in DataFrame functions alone.

Lines are normalised (A-Z and their like in lower case, runs of white space as one space) and hashed, and for each host the distinct
documents that hold a line are counted. A line that more than a share of the host's documents hold, and more than `least` of them, is
a menu, a notice or the like, and is removed; a document of which too little is left is rejected, as are those that fail the base rules.

Documents that are copies of a text count once for a host, or a group of copies would make frequent lines of its own. A line counts
once for a document however often it stands there. Only lines with a word count. Null hosts are a host of their own. Null text has no
words and no lines, and is rejected like any short text. Every row gives one row; rows that repeat an id are judged each by its text.

Each text is read once. What is kept of it is its numbers and one hash and one count for each of its lines; tables of frequent lines,
and of texts that have some, go through joins whose hot keys are looked up by broadcast (`looked_up`), or met by one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm._common import checkpointed, looked_up

#: White space that parts words, as a class of a pattern.
SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
#: A window's words, and the base rules' limits: words at least, and repeated words of a hundred at most.
WINDOW = 8
FEWEST, REPEATED = 20, 30
#: Of a host's documents, the share and the number that a line must exceed; and the share of a document's words that must be left.
SHARE, LEAST, LEFT = 0.1, 10, 0.5


def _bound(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def line_key(line: Column) -> Column:
    """64 bits of a normalised line."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, f"[{SPACE}]+", " "))))


def _count(text: Column, pattern: str) -> Column:
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))).cast("long")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in windows found twice or more. Windows are told apart by hashes, and equal hashes by their words."""
    n = F.size(words)

    def of_keys(keys: Column) -> Column:
        some = F.size(F.array_distinct(keys)) < F.size(keys)
        return F.when(some, _bound(F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))), of_sorted)).otherwise(F.lit(0))

    def of_sorted(order: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            return (a.getField("k") == b.getField("k")) & (F.slice(words, a.getField("i") + 1, window) == F.slice(words, b.getField("i") + 1, window))

        def place(x: Column, j: Column) -> Column:
            before = F.when(j > 0, same(x, F.get(order, j - 1))).otherwise(F.lit(False))
            return F.when(before | F.coalesce(same(x, F.get(order, j + 1)), F.lit(False)), x.getField("i"))

        places = F.array_sort(F.filter(F.transform(order, place), lambda i: i.isNotNull()))
        return _bound(places, lambda p: F.aggregate(F.transform(p, lambda i, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - i, F.lit(window)))), F.lit(0), lambda a, x: a + x))

    def of_hashes(hashes: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(window))))
        return _bound(keys, of_keys)

    return F.when(n > window, _bound(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)).otherwise(F.lit(0)).cast("long")


def measured(df: DataFrame, host: Column) -> DataFrame:
    """doc_id, host, one, two (128 bits of the text), the base counts, and lines: key and number of words of each line with a word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # a null host is named apart from any other
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.when(host.isNull(), "-").otherwise("+"), F.coalesce(host.cast("string"), F.lit(""))).alias("host"), text.alias("text"))
    raw = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    rows = docs.select("*", words_of(F.col("text")).alias("words"), raw.alias("raw"))
    return rows.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("one"),
        F.xxhash64(F.lit("another"), "text").alias("two"),
        F.size("words").cast("long").alias("n_words"),
        (F.char_length("text") - _count(F.col("text"), f"[{SPACE}]")).cast("long").alias("word_chars"),
        _count(F.col("text"), f"[{SYMBOLS}]").alias("n_symbols"),
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.transform("raw", lambda x: F.struct(line_key(x).alias("line"), F.size(words_of(x)).alias("n"))).alias("lines"),
    )


def frequent_lines(texts: DataFrame, share: float, least: int) -> DataFrame:
    """host, line, held: the lines of each host's texts (host, lines) that more than the limits hold. Tasks combine counts before the
    shuffle, and only those above `least` meet their host's number of texts."""
    hosts = checkpointed(texts.groupBy("host").agg(F.count("*").alias("texts")))
    lines = texts.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x.getField("line")))).alias("line"))
    counted = checkpointed(lines.groupBy("host", "line").agg(F.count("*").alias("held")).where(F.col("held") > least))
    # a host's weight is the number of its lines that are left
    weights = counted.groupBy("host").agg(F.count("*").alias("rows"))
    found = looked_up(counted, checkpointed(hosts.join(weights, "host")), ["host"], "rows")
    return found.where(F.col("held") > share * F.col("texts")).select("host", "line", "held")


def judged(df: DataFrame, host: Column, share: float = SHARE, least: int = LEAST, left: float = LEFT) -> tuple[DataFrame, DataFrame]:
    """doc_id, the counts, n_removed (words of removed lines), base_failed and kept for every row of df (doc_id, text and what `host`
    reads); and host, one, two, gone: the keys of the lines to remove from each text that has some."""
    base = checkpointed(measured(df, host))
    texts = checkpointed(base.groupBy("host", "one", "two").agg(F.first("lines").alias("lines"), F.count("*").alias("copies")))
    frequent = checkpointed(frequent_lines(texts, share, least))
    lines = texts.select("host", "one", "two", "copies", F.explode("lines").alias("x")).select("host", "one", "two", "copies", "x.line", "x.n")
    met = looked_up(lines, frequent, ["host", "line"], "held")
    removed = checkpointed(met.groupBy("host", "one", "two").agg(F.sum("n").alias("n_removed"), F.collect_set("line").alias("gone"), F.first("copies").alias("copies")))
    # copies of a text are a hot key, looked up by broadcast; texts that lose nothing don't meet anything
    cut = texts.select("host", "one", "two", "copies").join(removed.select("host", "one", "two", "n_removed"), ["host", "one", "two"], "left").fillna(0, ["n_removed"])
    rows = looked_up(base.drop("lines"), checkpointed(cut), ["host", "one", "two"], "copies")
    gone = F.col("n_removed")
    failed = (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    depleted = (F.col("n_words") - gone < FEWEST) | (F.col("n_words") - gone < left * F.col("n_words"))
    counts = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"
    return rows.select("doc_id", *counts, gone.alias("n_removed"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "host", "one", "two"), removed.select("host", "one", "two", "gone")


def rules(df: DataFrame, host: Column) -> DataFrame:
    """doc_id, the counts, n_removed, base_failed and kept for every row of df."""
    return judged(df, host)[0].drop("host", "one", "two")


def cleaned(df: DataFrame, host: Column, **limits: float) -> DataFrame:
    """df's rows that are kept, with the frequent lines taken out of text; its other columns as they are."""
    verdicts, gone = judged(df, host, **limits)
    # a text and its host decide, so one row of each serves all its copies
    named = verdicts.where("kept").select(*(F.col(c).alias(f"_{c}") for c in ("host", "one", "two"))).distinct()
    named = named.join(gone.select(*(F.col(c).alias(f"_{c}") for c in ("host", "one", "two")), F.col("gone").alias("_gone")), ["_host", "_one", "_two"], "left")
    keys = F.concat(F.when(host.isNull(), "-").otherwise("+"), F.coalesce(host.cast("string"), F.lit(""))), F.xxhash64("text"), F.xxhash64(F.lit("another"), "text")
    same = [k == F.col(f"_{c}") for k, c in zip(keys, ("host", "one", "two"), strict=True)]
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.coalesce(F.array_contains("_gone", line_key(x)), F.lit(False)) | ~x.rlike(f"[^{SPACE}]")), "\n")
    return df.join(named.hint("shuffle_merge"), same[0] & same[1] & same[2]).select(*(rest.alias(c) if c == "text" else F.col(c) for c in df.columns))


#: The rows of rules(documents, source) in SQL.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \\t-\\r]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS ls FROM d),
g AS (SELECT r, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
p AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM g) WHERE n > 1),
q AS (SELECT r, sum(least({WINDOW}, coalesce(j - i, {WINDOW}))) AS repeated FROM p GROUP BY r),
l AS (SELECT r, source, t, lower(trim(regexp_replace(x, '[ \\t-\\r]+', ' ', 'g'))) AS line, len(list_filter(regexp_split_to_array(x, '[ \\t-\\r]+'), lambda y: y <> '')) AS n FROM (SELECT r, source, t, unnest(ls) AS x FROM w)),
hosts AS (SELECT source, count(DISTINCT t) AS texts FROM d GROUP BY source),
f AS (SELECT l.source, l.line FROM l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source GROUP BY l.source, l.line, h.texts HAVING count(DISTINCT t) > {LEAST} AND count(DISTINCT t) > {SHARE} * h.texts),
m AS (SELECT r, sum(n) AS gone FROM l JOIN f ON l.line = f.line AND l.source IS NOT DISTINCT FROM f.source GROUP BY r),
c AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[ \\t-\\r]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(repeated, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed
      FROM w LEFT JOIN q USING (r) LEFT JOIN m USING (r)),
b AS (SELECT *, n_words < {FEWEST} OR 100 * n_repeat_words > {REPEATED} * n_words AS base_failed FROM c)
SELECT *, NOT base_failed AND n_words - n_removed >= {FEWEST} AND n_words - n_removed >= {LEFT} * n_words AS kept FROM b
"""
