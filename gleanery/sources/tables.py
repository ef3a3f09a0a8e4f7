"""Runs of tables as files: CSV for interchange, with the quoting that round-trips, and Parquet partitioned by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.scalars import sanitised

#: Quotes doubled, line feeds within quotes, blanks as blanks.
_CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "\\N", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

#: The columns of the tables' files.
FIELDS: dict[str, tuple[str, ...]] = {
    "pages": (
        "requested_url", "final_url", "domain", "http_status", "content_type", "title", "meta_description", "lang", "canonical_url", "og_title", "og_type", "og_description", "twitter_card", "json_ld_types", "tags_all",
        "url_content_hint", "content_kind_guess", "h1_joined", "word_count", "http_last_modified", "etag", "sitemap_lastmod", "referrer_sitemap_url", "heading_outline", "date_published", "date_modified", "visible_dates",
        "link_count_internal", "link_count_external", "link_count_total", "img_count", "img_missing_alt_count", "readability_fk_grade", "privacy_policy_url", "analytics_signals", "training_related_flag", "nav_link_count",
        "wcag_lang_valid", "wcag_heading_order_valid", "wcag_title_present", "wcag_form_labels_pct", "wcag_landmarks_present", "wcag_vague_link_pct", "wcag_img_alt_pct", "wcag_empty_headings", "wcag_duplicate_ids",
        "wcag_empty_buttons", "wcag_empty_links", "wcag_tables_no_headers", "wcag_autocomplete_pct", "wcag_has_search", "wcag_has_nav", "fetch_time_ms", "has_viewport_meta", "author", "publisher", "json_ld_id", "cms_generator",
        "robots_directives", "hreflang_links", "feed_urls", "pagination_next", "pagination_prev", "breadcrumb_schema", "microdata_types", "rdfa_types", "schema_price", "schema_currency", "schema_availability", "schema_rating",
        "schema_review_count", "schema_event_date", "schema_event_location", "schema_job_title", "schema_job_location", "schema_recipe_time", "extraction_coverage_pct", "extraction_coverage_core_pct", "content_hash",
        "content_changed", "referrer_url", "depth", "discovered_at",
    ),
    "edges": ("from_url", "to_url", "link_text", "discovered_at"),
    "tags": ("page_url", "tag_value", "tag_source", "discovered_at"),
    "nav_links": ("page_url", "nav_href", "nav_text", "discovered_at"),
    "sitemap_urls": ("url", "lastmod", "source_sitemap", "discovered_at"),
    "phone_numbers": ("page_url", "raw_href", "phone_number", "link_text", "discovered_at"),
    "link_checks": ("from_url", "to_url", "check_status", "check_final_url", "check_message", "discovered_at"),
    "assets": ("referrer_page_url", "asset_url", "link_text", "category", "head_content_type", "head_content_length", "discovered_at"),
    "keyword_log": (
        "keyword", "match_count", "requested_url", "final_url", "domain", "http_status", "content_type", "title", "meta_description", "lang", "canonical_url", "url_content_hint", "content_kind_guess", "author", "publisher",
        "json_ld_types", "og_type", "tags_all", "word_count", "date_published", "date_modified", "cms_generator", "breadcrumb_schema", "training_related_flag", "referrer_url", "depth", "discovered_at",
    ),
    "crawl_errors": ("url", "final_url", "referrer_url", "depth", "error_type", "failure_class", "message", "http_status", "content_type", "redirect_count", "last_redirect_url", "attempt_number", "robots_txt_rule", "worker_id", "discovered_at"),
}


#: What a fetcher leaves of each URL.
CAPTURES = "url string, final_url string, http_status int, content_type string, html string, rendered_html string, headers map<string,string>, fetch_time_ms double, fetched_at timestamp"


def read_captures(spark: SparkSession, path: str, *, stream: bool = False, files: int | None = None) -> DataFrame:
    """Captures as Parquet, with nulls for columns that files lack; as a stream, some files at a time."""
    reader = (spark.readStream if stream else spark.read).schema(CAPTURES)
    return (reader.option("maxFilesPerTrigger", files) if stream and files else reader).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern names any file, on whatever file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """All cells are strings. With columns, those come, absent ones blank; a missing or empty file has no rows. Anything else
    that is wrong raises."""
    df = spark.read.options(**_CSV).csv(path) if exists(spark, path) else None
    if df is None or not df.columns:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns or ()]))
    if columns is None:
        return df.fillna("")
    return df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns))


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...] | None = None, most: int | None = 32_000, by: str | None = None) -> None:
    """Cells sanitised (cut beyond `most` characters, or not at all), every one quoted; further columns are dropped. With `by`, a
    folder for each value of that column, in one pass. Rows with a seq that isn't a column of the file are written in its order, from
    one part file to the next."""
    names = columns or tuple(df.columns)
    if "seq" in df.columns and "seq" not in names:
        df = df.repartitionByRange("seq").sortWithinPartitions(*([by] if by else []), "seq")
    rows = df.select(*((sanitised(F.col(c).cast("string"), most) if c in df.columns else F.lit("")).alias(c) for c in names), *([F.col(by).alias("_by")] if by else []))
    rows.write.mode("overwrite").partitionBy(*(["_by"] if by else [])).options(header="true", quoteAll="true", quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def append_run(df: DataFrame, path: str, run: str, by: tuple[str, ...] = ()) -> None:
    """A run as Parquet, below run=...; a run that is written again replaces what it wrote before."""
    df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", *by).parquet(path)


def read_runs(spark: SparkSession, path: str, *runs: str) -> DataFrame:
    """Runs of a table; which ones prunes partitions."""
    df = spark.read.parquet(path).withColumn("run", F.col("run").cast("string"))
    return df.where(F.col("run").isin(*runs)) if runs else df


def count_rows(spark: SparkSession, path: str) -> int:
    """Records, not lines."""
    return read_csv(spark, path).count()


def robots_sitemaps(robots: DataFrame, text: str = "txt") -> DataFrame:
    """The sitemaps that robots files name, a row each."""
    lines = robots.select("*", F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\\R")).alias("line")).where(F.col("line").rlike("(?i)^\\s*sitemap:"))
    return lines.withColumn("sitemap", F.trim(F.regexp_replace("line", "(?i)^\\s*sitemap:", ""))).where("sitemap <> ''").drop("line", text)


#: What sitemaps and indexes of them hold, and where the parser puts what it can't read.
_ENTRY = "array<struct<loc: string, lastmod: string>>"
_SITEMAP = f"url {_ENTRY}, sitemap {_ENTRY}, _broken string"


def sitemap_entries(sitemaps: DataFrame, url: str = "url", xml: str = "xml") -> DataFrame:
    """url, kind (urlset or index), loc and lastmod of each entry, by Spark's XML parser; malformed documents have none, nor have
    those whose root is another. Namespaces are passed over."""
    document = F.trim(F.coalesce(F.col(xml), F.lit("")))
    root = F.lower(F.regexp_extract(document, r"(?s)^(?:\s|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>)*<(?:[\w.-]+:)?([\w.-]+)", 1))
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "ignoreSurroundingSpaces": "true"}
    read = sitemaps.select(F.col(url).alias("url"), root.alias("_root"), document.alias("_xml")).where(F.col("_root").isin("urlset", "sitemapindex"))
    parsed = read.select("url", "_root", F.from_xml("_xml", _SITEMAP, options).alias("_x")).where("_x is not null and _x._broken is null")
    entries = F.concat(F.coalesce("_x.url", F.array().cast(_ENTRY)), F.coalesce("_x.sitemap", F.array().cast(_ENTRY)))
    rows = parsed.select("url", F.when(F.col("_root") == "sitemapindex", "index").otherwise("urlset").alias("kind"), F.explode(entries).alias("e"))
    out = rows.select("url", "kind", F.trim(F.coalesce("e.loc", F.lit(""))).alias("loc"), F.trim(F.coalesce("e.lastmod", F.lit(""))).alias("lastmod"))
    return out.where("loc <> ''")


def expand_sitemaps(documents: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """loc and lastmod of all that the roots' sitemaps list, through indexes of indexes, however deep: documents has url and
    xml. Each sitemap is read once, whatever indexes name it, so that indexes that name one another end; levels are checkpointed
    in the shared folder. With `most`, only so many URLs, the first by name."""
    from gleanery.session import shared_folder

    shared_folder(documents.sparkSession)
    entries = sitemap_entries(documents).checkpoint()
    seen = roots.select("url").distinct().checkpoint()
    level = seen
    while True:
        named = entries.where("kind = 'index'").join(level, "url", "left_semi").select(F.col("loc").alias("url")).distinct()
        level = named.join(seen, "url", "left_anti").checkpoint()
        if level.isEmpty():
            break
        seen = seen.union(level).checkpoint()
    listed = entries.where("kind = 'urlset'").join(seen, "url", "left_semi").groupBy("loc").agg(F.max("lastmod").alias("lastmod"))
    return listed if most is None else listed.orderBy("loc").limit(most)
