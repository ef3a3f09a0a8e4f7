"""Where a crawl starts and what a first look at domains shows; and the browser's remaining views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions import urls
from gleanery.functions.scalars import as_int, filled, rounded
from gleanery.operators import extract
from gleanery.operators.frames import counts, top
from gleanery.plans.registry import Site, host, integer, near, pct, query
from gleanery.plans.reports import SIGNALS, _tags, authors_top, mean_above_zero, schema_type_freq, share, sql_mean_above_zero
from gleanery.sources import kept, tables

_SQL_CRAWL_KEY = "regexp_replace(concat('https://', lower(regexp_extract({u}, '://([^/?#]*)', 1)), CASE WHEN regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1) END, CASE WHEN regexp_extract({u}, '^[^#?]*[?]([^#]*)', 1) = '' THEN '' ELSE concat('?', array_to_string(list_sort(string_split(regexp_extract({u}, '^[^#?]*[?]([^#]*)', 1), '&')), '&')) END), '/+$', '')"


def start_items(seeds: DataFrame, listed: DataFrame, of_robots: DataFrame | None = None, visited: DataFrame | None = None) -> DataFrame:
    """Seeds, then sitemap URLs, then those of sitemaps that robots files name, each crawl key once: the first by (source, order)
    wins. What has been visited (column k, crawl keys) is left out."""
    parts = [(seeds, "seed"), (listed, "sitemap"), *([(of_robots, "robots")] if of_robots is not None else [])]
    both = None
    for rank, (df, source) in enumerate(parts):
        one = df.select("url", F.lit(source).alias("source"), F.lit(rank).alias("rank"), "seq")
        both = one if both is None else both.unionByName(one)
    keyed = both.withColumn("k", urls.crawl_key("url"))
    first = keyed.groupBy("k").agg(F.min(F.struct("rank", "seq", "url", "source")).alias("x"))
    if visited is not None:
        first = first.join(visited.select("k").distinct(), "k", "left_anti")
    return first.select("x.url", "x.source")


_SQL_STARTS = "SELECT url, source FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY rk, seq, url) AS n FROM (SELECT url, 'seed' AS source, 0 AS rk, i AS seq FROM base WHERE i % 3 = 0 UNION ALL SELECT url, 'sitemap', 1, seq FROM sitemap_urls {more})) WHERE n = 1"


@query("start_items", _SQL_STARTS.format(k=_SQL_CRAWL_KEY.format(u="url"), more=""))
def _start_items(s: Site) -> DataFrame:
    seeds = s.table("pages").where("page_id % 3 = 0").select("url", F.col("page_id").alias("seq"))
    return start_items(seeds, s.estate.sitemap_urls.select("url", "seq"))


@query("start_items_resumed", _SQL_STARTS.format(k=_SQL_CRAWL_KEY.format(u="url"), more="UNION ALL SELECT url, 'robots', 2, i FROM base WHERE i % 5 < 2") + f" AND {_SQL_CRAWL_KEY.format(u='url')} NOT IN (SELECT {_SQL_CRAWL_KEY.format(u='url')} FROM errors)")
def start_items_resumed(s: Site) -> DataFrame:
    """With the sitemaps of robots files, and without what errors show to have been tried."""
    pages = s.table("pages").select("url", F.col("page_id").alias("seq"))
    return start_items(pages.where("seq % 3 = 0"), s.estate.sitemap_urls.select("url", "seq"), pages.where("seq % 5 < 2"), s.estate.errors.select(urls.crawl_key("url").alias("k")))


def kept_start_items(spark: SparkSession, seeds: DataFrame, listed: DataFrame, *inputs: object) -> DataFrame:
    """start_items, made once for the files that both are read from and for `inputs`, what else decides them, and read again for as
    long as these hold: a crawl that is started anew doesn't read its sitemaps again."""
    return kept.kept(spark, "start_items", lambda: start_items(seeds, listed), kept.files_of(seeds), kept.files_of(listed), *inputs)


@query("start_items_kept", f"{_SQL_STARTS.format(k=_SQL_CRAWL_KEY.format(u='url'), more='')} UNION ALL SELECT concat(url, ' again') AS url, source FROM ({_SQL_STARTS.format(k=_SQL_CRAWL_KEY.format(u='url'), more='').replace('i % 3 = 0', 'i % 3 = 1')})")
def start_items_kept(s: Site) -> DataFrame:
    """The same seeds twice, which are made once and read the second time, and other seeds, which are made anew."""
    pages = s.table("pages").select("url", F.col("page_id").alias("seq"))
    listed = s.estate.sitemap_urls.select("url", "seq")
    first, again, other = (kept_start_items(s.spark, pages.where(f"seq % 3 = {n}"), listed, "seq % 3", n) for n in (0, 0, 1))
    assert first.inputFiles() == again.inputFiles() != other.inputFiles()
    return again.union(other.select(F.concat("url", F.lit(" again")), "source"))


_SQL_SITEMAPS = """SELECT page_id, concat(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), '/sitemap-', CAST(page_id AS STRING), '.xml') AS url, CASE page_id % 5
WHEN 0 THEN concat('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> ', replace(url, '&', '&amp;'), ' </loc><lastmod>2024-01-0', CAST(1 + page_id % 9 AS STRING), '</lastmod></url><url><loc>https://far.example.org/', CAST(page_id AS STRING), '</loc></url></urlset>')
WHEN 1 THEN concat('<s:sitemapindex xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9"><s:sitemap><s:loc>', replace(url, '&', '&amp;'), '.xml</s:loc></s:sitemap></s:sitemapindex>')
WHEN 2 THEN concat('<urlset><url><loc>', replace(url, '&', '&amp;'), '</loc></url>')
WHEN 3 THEN concat('<!-- made --><urlset><url><lastmod>2024</lastmod></url><url><priority>1</priority><loc><![CDATA[', url, ']]></loc></url></urlset>')
ELSE 'no sitemap' END AS xml FROM pages"""


@query("sitemap_entries", "SELECT sm.url, kind, loc, lastmod FROM (SELECT page_id, 'urlset' AS kind, url AS loc, concat('2024-01-0', CAST(1 + page_id % 9 AS VARCHAR)) AS lastmod FROM pages WHERE page_id % 5 = 0 UNION ALL SELECT page_id, 'urlset', concat('https://far.example.org/', CAST(page_id AS VARCHAR)), '' FROM pages WHERE page_id % 5 = 0 UNION ALL SELECT page_id, 'index', concat(url, '.xml'), '' FROM pages WHERE page_id % 5 = 1 UNION ALL SELECT page_id, 'urlset', url, '' FROM pages WHERE page_id % 5 = 3) e JOIN sm USING (page_id)", f"sm AS ({_SQL_SITEMAPS})")
def sitemap_entries(s: Site) -> DataFrame:
    """Sitemaps of all kinds, made of the pages' addresses: Spark's XML parser leaves out the malformed."""
    documents = s.spark.sql(_SQL_SITEMAPS.replace("FROM pages", "FROM {source}"), source=s.table("pages"))
    return tables.sitemap_entries(documents)


@query("dedup_targets", f"SELECT h AS netloc, arg_min(url, i) AS url FROM (SELECT i, url, {host('url')} AS h FROM base) GROUP BY 1")
def dedup_targets(s: Site) -> DataFrame:
    """The first URL of each netloc."""
    return s.table("pages").groupBy(urls.netloc("url").alias("netloc")).agg(F.min_by("url", "page_id").alias("url"))


@query("origin_counts", "SELECT regexp_extract(url, '^([^/?#]+//[^/?#]*)', 1) AS origin, count(*) AS n FROM base GROUP BY 1")
def origin_counts(s: Site) -> DataFrame:
    return counts(s.table("pages"), urls.origin("url").alias("origin"))


_SQL_LISTED = f"sm AS (SELECT {_SQL_CRAWL_KEY.format(u='url')} AS k, max(lastmod) AS lastmod FROM sitemap_urls GROUP BY 1)"


@query("sitemap_meta", f"SELECT p.requested_url, coalesce(m.lastmod, n.lastmod) AS lastmod FROM p LEFT JOIN sm m ON m.k = {_SQL_CRAWL_KEY.format(u='p.requested_url')} LEFT JOIN sm n ON n.k = {_SQL_CRAWL_KEY.format(u='p.final_url')}", _SQL_LISTED)
def sitemap_meta(s: Site) -> DataFrame:
    """What sitemaps say of a page, by the URL requested, else by the final one."""
    listed = s.estate.sitemap_urls.groupBy(urls.crawl_key("url").alias("k")).agg(F.max("lastmod").alias("lastmod"))
    rows = s.pages.select("requested_url", urls.crawl_key("requested_url").alias("k"), urls.crawl_key("final_url").alias("k2"))
    rows = rows.join(listed, "k", "left").join(listed.select(F.col("k").alias("k2"), F.col("lastmod").alias("second")), "k2", "left")
    return rows.select("requested_url", F.coalesce("lastmod", "second").alias("lastmod"))


_ROBOTS_TEXT = "User-agent: *\nDisallow: /\n"


@query("preflight_robots", "SELECT o AS origin, n, regexp_extract(o, '([a-z]+)$', 1) = 'net' AS blocked FROM (SELECT regexp_extract(url, '^([^/?#]+//[^/?#]*)', 1) AS o, count(*) AS n FROM base GROUP BY 1)")
def preflight_robots(s: Site) -> DataFrame:
    """Of each origin that is queued: how many URLs, and whether its robots file keeps all of it off."""
    origins = counts(s.table("pages"), urls.origin("url").alias("origin"))
    robots = origins.where(F.col("origin").endswith(".net")).select("origin", F.lit(_ROBOTS_TEXT).alias("txt"))
    judged = extract.robots_allowed(origins.withColumn("root", F.concat("origin", F.lit("/"))), robots, "Bot", "root")
    return judged.select("origin", "n", (~F.col("allowed")).alias("blocked"))


@query("precrawl_summary", f"SELECT domain, count(*) AS pages, bool_or(trim(json_ld_types) <> '') AS has_json_ld, bool_or(trim(og_type) <> '') AS has_og, bool_or(wcag_has_nav = '1') AS has_nav, {near(f'avg({integer("word_count")})')} AS avg_words, array_to_string(list_sort(list(DISTINCT content_kind_guess) FILTER (trim(content_kind_guess) <> '')), '|') AS kinds FROM pages_raw GROUP BY 1")
def precrawl_summary(s: Site) -> DataFrame:
    kinds = F.array_join(F.array_sort(F.collect_set(F.when(filled("content_kind_guess"), F.col("content_kind_guess")))), "|")
    found = s.estate.pages_raw.groupBy("domain").agg(F.count("*").alias("pages"), F.bool_or(filled("json_ld_types")).alias("has_json_ld"), F.bool_or(filled("og_type")).alias("has_og"), F.bool_or(F.col("wcag_has_nav") == "1").alias("has_nav"), rounded(F.avg(as_int("word_count"))).alias("avg_words"), kinds.alias("kinds"), F.count_if(filled("content_kind_guess")).alias("_k"))
    return found.withColumn("kinds", F.when(F.col("_k") > 0, F.col("kinds"))).drop("_k")


@query("word_cloud", "SELECT * FROM (SELECT 'tags' AS cloud, lower(trim(tag_value)) AS word, count(*) AS n FROM tg WHERE trim(tag_value) <> '' AND length(trim(tag_value)) <= 80 GROUP BY ALL ORDER BY n DESC, word LIMIT 100) UNION ALL SELECT * FROM (SELECT 'authors', trim(author) AS w, count(*) AS n FROM p WHERE trim(author) <> '' GROUP BY ALL ORDER BY n DESC, w LIMIT 50)")
def word_cloud(s: Site) -> DataFrame:
    tags = top(counts(_tags(s), "tag"), 100, "n", "tag").select(F.lit("tags").alias("cloud"), F.col("tag").alias("word"), "n")
    return tags.union(authors_top(s).select(F.lit("authors"), "author", "pages"))


@query("type_cloud", "SELECT t AS type, count(*) AS n FROM (SELECT unnest(list_filter(list_transform(string_split(concat(json_ld_types, '|', microdata_types), '|'), lambda x: trim(x)), lambda x: x <> '')) AS t FROM p) GROUP BY 1 ORDER BY n DESC, t LIMIT 40")
def type_cloud(s: Site) -> DataFrame:
    return schema_type_freq(s)


@query("content_bubbles", "SELECT *, CAST(sum(n) OVER (PARTITION BY domain) AS BIGINT) AS total FROM (SELECT domain, trim(content_kind_guess) AS kind, count(*) AS n FROM p WHERE trim(content_kind_guess) <> '' GROUP BY ALL)")
def content_bubbles(s: Site) -> DataFrame:
    pairs = counts(s.pages.where(filled("content_kind_guess")), "domain", F.trim("content_kind_guess").alias("kind"))
    return pairs.withColumn("total", F.sum("n").over(Window.partitionBy("domain")))


@query("structured_strip", "SELECT domain, " + ", ".join(f"{pct(f'count(*) FILTER ({c})', 'count(*)')} AS {k}" for k, (_, c) in SIGNALS.items()) + ", count(*) AS pages FROM p GROUP BY 1 HAVING count(*) >= 2 ORDER BY pages DESC, domain LIMIT 40")
def structured_strip(s: Site) -> DataFrame:
    rows = s.pages.groupBy("domain").agg(*(share(F.count_if(c()), F.count("*")).alias(k) for k, (c, _) in SIGNALS.items()), F.count("*").alias("pages"))
    return top(rows.where("pages >= 2"), 40, "pages", "domain")


@query(
    "parallel_coordinates",
    f"""SELECT q.*, coalesce(e.n, 0) AS errors, coalesce(a.n, 0) AS assets FROM (SELECT domain, count(*) AS pages, CAST(round_even(CAST(sum({integer('word_count')}) AS DOUBLE) / count(*), 0) AS BIGINT) AS words, {sql_mean_above_zero('readability_fk_grade')} AS readability, {near(f'CAST(sum({integer("link_count_internal")}) AS DOUBLE) / count(*)')} AS internal_links,
{near(f'CAST(sum({integer("link_count_external")}) AS DOUBLE) / count(*)')} AS external_links, {sql_mean_above_zero('extraction_coverage_pct')} AS coverage, {sql_mean_above_zero('extraction_coverage_core_pct')} AS coverage_core, {pct("count(*) FILTER (trim(json_ld_types) <> '')", 'count(*)')} AS json_ld_pct, {pct("count(*) FILTER (trim(microdata_types) <> '')", 'count(*)')} AS microdata_pct
FROM p GROUP BY 1 HAVING count(*) >= 5 ORDER BY pages DESC, domain LIMIT 60) q LEFT JOIN (SELECT {host('url')} AS h, count(*) AS n FROM er GROUP BY 1) e ON e.h = domain LEFT JOIN (SELECT {host('referrer_page_url')} AS h, count(*) AS n FROM ast GROUP BY 1) a ON a.h = domain""",
)
def parallel_coordinates(s: Site, least: int = 5, most: int = 60) -> DataFrame:
    """Eleven measures of each domain with enough pages, the biggest first."""
    n = F.count("*")
    rows = s.pages.groupBy("domain").agg(
        n.alias("pages"),
        F.rint(F.sum(as_int("word_count")) / n).cast("long").alias("words"),
        mean_above_zero("readability_fk_grade").alias("readability"),
        rounded(F.sum(as_int("link_count_internal")) / n).alias("internal_links"),
        rounded(F.sum(as_int("link_count_external")) / n).alias("external_links"),
        mean_above_zero("extraction_coverage_pct").alias("coverage"),
        mean_above_zero("extraction_coverage_core_pct").alias("coverage_core"),
        share(F.count_if(filled("json_ld_types")), n).alias("json_ld_pct"),
        share(F.count_if(filled("microdata_types")), n).alias("microdata_pct"),
    )
    rows = top(rows.where(F.col("pages") >= least), most, "pages", "domain")
    errors, assets = counts(s.errors, urls.host("url").alias("domain"), name="errors"), counts(s.assets, urls.host("referrer_page_url").alias("domain"), name="assets")
    return rows.join(errors, "domain", "left").join(assets, "domain", "left").fillna(0, ["errors", "assets"])
