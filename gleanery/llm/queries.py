"""The queries over the synthetic tables, one for each operator of this subpackage, with production parameters, and some of parts of
their rows that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm._common import table
from gleanery.llm import alignment, fim, langid, line_rules, quality
from gleanery.llm.media import store_texts
from gleanery.llm.mixing import mix
from gleanery.llm.pii import detect
from gleanery.llm.sentencepiece_codec import count_tokens, digests
from gleanery.llm.simhash import near_duplicates
from gleanery.llm.substring import substring_dedup
from gleanery.llm.topk import ORACLE, search


def vocabulary(name: str = "piece_bpe_32k.model") -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole text without stretches of 50 words and more that a smaller doc_id holds."""
    return substring_dedup(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded with begin and end ids and decoded again, as digests."""
    return digests(table(spark, sf_dir, "documents"), vocabulary())


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored as a PPM or BMP image, cut into NPY tiles and read back from them, with features."""
    return store_texts(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and the near-duplicate component of each."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text, learned from two thirds of the labels."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes of each."""
    return mix(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from four fifths of the documents."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text, plain and disguised."""
    return detect(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, and whether they are over 4096."""
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary())


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of each vector whose id is divisible by 100."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text cut for filling in the middle, and put together again, as digests."""
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text by the base rules and by the lines that many documents of its source hold."""
    return line_rules.rules(table(spark, sf_dir, "documents"), F.col("source"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text aligned between two vocabularies, with its linked pairs' counts over the corpus."""
    return alignment.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary())


# What SQL can say of operators that it can't express as a whole, from the same rows


def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and payload of op3's stored forms, as they are read back."""
    return op3_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


MEDIA_PAYLOAD = """
SELECT doc_id, n AS n_bytes, p AS payload_bytes, sha256(concat(t, repeat(' ', p - n))) AS payload_sha256
FROM (SELECT *, greatest(192, (n + 191) // 192 * 192) AS p FROM (SELECT doc_id, coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents))
"""


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of op6's documents and sources, and their targets."""
    return op6_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target")


#: Sources in the order of their greatest share for a unit of weight: the first of them stop, and the rest shares what is left.
MIXING_TARGETS = r"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS z, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * z / w, source NULLS LAST) AS k, sum(z) OVER () AS t FROM s),
l AS (SELECT *, CAST(t - 3 * coalesce(sum(z) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest, CAST(sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS ws FROM o),
f AS (SELECT min(k) AS first FROM l WHERE rest * w <= 3 * z * ws),
g AS (SELECT l.source, l.z, CASE WHEN l.k < f.first THEN CAST(3 * l.z AS DOUBLE) ELSE CAST(b.rest * l.w AS DOUBLE) / CAST(b.ws AS DOUBLE) END AS target FROM l, f, l AS b WHERE b.k = f.first)
SELECT d.doc_id, d.size, g.z AS source_size, g.target FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
"""


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of op8's base spans."""
    return op8_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


MATCHES = "CAST(len(list_filter(regexp_extract_all(t, '{pattern}'), lambda x: {test})) AS BIGINT) AS n_{kind}"
_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), i, 1) AS INT) ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(substr(reverse({_DIGITS}), i, 1) AS INT) + 1] END)) % 10 = 0"
PII_BASE_COUNTS = "SELECT doc_id, " + ", ".join(
    MATCHES.format(kind=kind, pattern=pattern, test=test)
    for kind, pattern, test in (
        ("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+", "TRUE"),
        ("ip", "[0-9]+([.][0-9]+)([.][0-9]+)([.][0-9]+)", "len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || right(p, 3) AS INT) > 255)) = 0"),
        ("card", "[0-9]([ -]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
        ("phone", "[+][0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
    )
) + " FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring": op1_substring,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_media": op3_media,
    "op4_simhash": op4_simhash,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_language": op7_language,
    "op8_pii": op8_pii,
    "op9_token_counts": op9_token_counts,
    "op10_topk": op10_topk,
    "op11_fim": op11_fim,
    "op12_line_rules": op12_line_rules,
    "op13_alignment": op13_alignment,
    "media_payload": media_payload,
    "mixing_targets": mixing_targets,
    "pii_base_counts": pii_base_counts,
}

#: SQL for what it can express over whole tables in fair time; the others are tested against plain versions.
ORACLE_SQL: dict[str, str] = {"op10_topk": ORACLE, "op11_fim": fim.ORACLE, "op12_line_rules": line_rules.ORACLE, "media_payload": MEDIA_PAYLOAD, "mixing_targets": MIXING_TARGETS, "pii_base_counts": PII_BASE_COUNTS}
