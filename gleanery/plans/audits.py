"""Content audits, accessibility criteria, run metrics and field coverage. Severities are of shares of all pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import urls
from gleanery.functions.scalars import as_float, as_int, filled, rounded, share, text
from gleanery.operators import frames
from gleanery.operators.frames import capped, counts, top
from gleanery.plans.registry import ORACLE_SQL, Site, host, integer, near, pct, query, real
from gleanery.sources.estate import RUNS
from gleanery.sources.tables import FIELDS


def severity(percent: Column) -> Column:
    return F.when(percent >= 25, "high").when(percent >= 10, "medium").when(percent > 0, "low").otherwise("none")


def sql_severity(percent: str) -> str:
    return f"CASE WHEN {percent} >= 25 THEN 'high' WHEN {percent} >= 10 THEN 'medium' WHEN {percent} > 0 THEN 'low' ELSE 'none' END"


# Findings: name -> rows of pages


def thin(s: Site) -> DataFrame:
    words = as_int("word_count")
    issues = F.array_compact(F.array(F.when(words < 50, F.concat(words.cast("string"), F.lit(" words"))), F.when(~filled("heading_outline"), F.lit("no headings")), F.when(as_int("link_count_internal") == 0, F.lit("no internal links"))))
    return s.pages.withColumn("issues", F.array_join(issues, "; ")).withColumn("n_issues", F.size(issues).cast("long")).where("n_issues > 0")


SQL_THIN = f"th AS (SELECT * FROM (SELECT *, concat_ws('; ', CASE WHEN {integer('word_count')} < 50 THEN concat({integer('word_count')}, ' words') END, CASE WHEN trim(heading_outline) = '' THEN 'no headings' END, CASE WHEN {integer('link_count_internal')} = 0 THEN 'no internal links' END) AS issues, CAST({integer('word_count')} < 50 AS BIGINT) + CAST(trim(heading_outline) = '' AS BIGINT) + CAST({integer('link_count_internal')} = 0 AS BIGINT) AS n_issues FROM p) WHERE n_issues > 0)"


@query("audit_thin", f"SELECT final_url AS url, domain, substr(title, 1, 80) AS title, {integer('word_count')} AS words, n_issues, issues FROM th ORDER BY n_issues DESC, url LIMIT 100", SQL_THIN)
def audit_thin(s: Site, cap: int | None = 100) -> DataFrame:
    return capped(thin(s).select(F.col("final_url").alias("url"), "domain", F.substring("title", 1, 80).alias("title"), as_int("word_count").alias("words"), "n_issues", "issues").orderBy(F.desc("n_issues"), "url"), cap)


@query("audit_thin_domains", "SELECT domain, count(*) AS n FROM th GROUP BY 1 ORDER BY n DESC, domain LIMIT 20", SQL_THIN)
def audit_thin_domains(s: Site) -> DataFrame:
    return top(counts(thin(s), "domain"), 20, "n", "domain")


_SQL_REPEATED = "du AS (SELECT 'both' AS kind, title, description, count(*) AS n, min(final_url) AS first_url FROM (SELECT trim(title) AS title, trim(meta_description) AS description, final_url FROM p) WHERE title <> '' AND description <> '' GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT 'title', trim(title), '', count(*), min(final_url) FROM p WHERE trim(title) <> '' GROUP BY 2 HAVING count(*) > 1)"


def repeated(s: Site) -> DataFrame:
    """Groups of pages by title and description, and by title."""
    rows = s.pages.where(filled("title")).select(F.trim("title").alias("title"), F.trim("meta_description").alias("description"), "final_url")
    both = rows.where("description <> ''").select(F.lit("both").alias("kind"), "title", "description", "final_url")
    alone = rows.select(F.lit("title").alias("kind"), "title", F.lit("").alias("description"), "final_url")
    return both.union(alone).groupBy("kind", "title", "description").agg(F.count("*").alias("n"), F.min("final_url").alias("first_url")).where("n > 1")


@query("audit_duplicates", "SELECT kind, title, description, n, first_url FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, title, description) AS k FROM du) WHERE k <= 50", _SQL_REPEATED)
def audit_duplicates(s: Site, cap: int | None = 50) -> DataFrame:
    rows = repeated(s)
    return top(rows, cap, "n", "title", "description", per="kind") if cap else rows


@query("audit_duplicates_summary", f"SELECT n AS groups, least(affected, total) AS affected, total, {sql_severity('100.0 * affected / total')} AS severity FROM (SELECT count(*) AS n, CAST(coalesce(sum(least(n, 20)), 0) AS BIGINT) AS affected, (SELECT count(*) FROM p) AS total FROM du)", _SQL_REPEATED)
def audit_duplicates_summary(s: Site) -> DataFrame:
    """Pages affected are those that are shown, 20 of a group, as the report counts them."""
    found = repeated(s).agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.least("n", F.lit(20))), F.lit(0)).alias("a"))
    both = found.join(F.broadcast(s.pages.agg(F.count("*").alias("total"))))
    return both.select("groups", F.least("a", "total").alias("affected"), "total", severity(100.0 * F.col("a") / F.col("total")).alias("severity"))


_SQL_REDIRECTS = f"rd AS (SELECT requested_url, final_url, {host('requested_url')} <> {host('final_url')} AS is_cross FROM p WHERE trim(final_url) <> '' AND requested_url <> final_url)"


def redirects(s: Site) -> DataFrame:
    return s.pages.where(filled("final_url") & (F.col("requested_url") != F.col("final_url"))).select("requested_url", "final_url", (urls.host("requested_url") != urls.host("final_url")).alias("is_cross"))


@query("audit_redirects", "SELECT * FROM rd ORDER BY is_cross DESC, requested_url LIMIT 100", _SQL_REDIRECTS)
def audit_redirects(s: Site, cap: int | None = 100) -> DataFrame:
    return capped(redirects(s).orderBy(F.desc("is_cross"), "requested_url"), cap)


_LENGTHS = {"missing_title": ("title", 0, 0), "short_title": ("title", 1, 29), "long_title": ("title", 61, 1 << 30), "missing_description": ("meta_description", 0, 0), "short_description": ("meta_description", 1, 69), "long_description": ("meta_description", 161, 1 << 30)}


@query("audit_title_meta", "SELECT " + ", ".join(f"count(*) FILTER (length(trim({c})) BETWEEN {a} AND {b}) AS {k}" for k, (c, a, b) in _LENGTHS.items()) + ", count(*) FILTER (length(trim(title)) NOT BETWEEN 30 AND 60 OR length(trim(meta_description)) NOT BETWEEN 70 AND 160) AS affected FROM p")
def audit_title_meta(s: Site) -> DataFrame:
    size = lambda c: F.length(F.trim(c))
    either = ~size("title").between(30, 60) | ~size("meta_description").between(70, 160)
    return s.pages.agg(*(F.count_if(size(c).between(a, b)).alias(k) for k, (c, a, b) in _LENGTHS.items()), F.count_if(either).alias("affected"))


_SQL_LENGTH_ISSUES = "concat_ws('; ', CASE WHEN length(t) = 0 THEN 'missing title' WHEN length(t) < 30 THEN concat('short title (', length(t), ' chars)') WHEN length(t) > 60 THEN concat('long title (', length(t), ' chars)') END, CASE WHEN length(d) = 0 THEN 'missing description' WHEN length(d) < 70 THEN concat('short description (', length(d), ' chars)') WHEN length(d) > 160 THEN concat('long description (', length(d), ' chars)') END)"


@query("audit_title_meta_pages", f"SELECT url, domain, title_length, description_length, issues FROM (SELECT final_url AS url, domain, CAST(length(t) AS INT) AS title_length, CAST(length(d) AS INT) AS description_length, {_SQL_LENGTH_ISSUES} AS issues FROM (SELECT *, trim(title) AS t, trim(meta_description) AS d FROM p)) WHERE issues <> '' ORDER BY url, issues LIMIT 100")
def audit_title_meta_pages(s: Site, cap: int | None = 100) -> DataFrame:
    def issue(what: str, size: Column, least: int, most: int) -> Column:
        said = F.concat(F.lit(f" {what} ("), size.cast("string"), F.lit(" chars)"))
        return F.when(size == 0, F.lit(f"missing {what}")).when(size < least, F.concat(F.lit("short"), said)).when(size > most, F.concat(F.lit("long"), said))

    t, d = F.length(F.trim("title")), F.length(F.trim("meta_description"))
    rows = s.pages.select(F.col("final_url").alias("url"), "domain", t.alias("title_length"), d.alias("description_length"), F.concat_ws("; ", issue("title", t, 30, 60), issue("description", d, 70, 160)).alias("issues"))
    return capped(rows.where("issues <> ''").orderBy("url", "issues", "domain", "title_length", "description_length"), cap)


_SQL_ORPHANS = "op AS (SELECT final_url AS url, domain, starts_with(referrer_url, 'sitemap:') AS from_sitemap FROM p WHERE trim(final_url) <> '' AND final_url NOT IN (SELECT to_url FROM ed))"


def orphans(s: Site) -> DataFrame:
    linked = s.edges.select(F.col("to_url").alias("final_url")).distinct()
    return s.pages.where(filled("final_url")).join(linked, "final_url", "left_anti").select(F.col("final_url").alias("url"), "domain", F.col("referrer_url").startswith("sitemap:").alias("from_sitemap"))


@query("audit_orphans", "SELECT * FROM op", _SQL_ORPHANS)
def audit_orphans(s: Site) -> DataFrame:
    return orphans(s)


@query("audit_orphan_domains", "SELECT domain, count(*) AS n, count(*) FILTER (from_sitemap) AS from_sitemaps FROM op GROUP BY 1 ORDER BY n DESC, domain LIMIT 20", _SQL_ORPHANS)
def audit_orphan_domains(s: Site) -> DataFrame:
    return top(orphans(s).groupBy("domain").agg(F.count("*").alias("n"), F.count_if("from_sitemap").alias("from_sitemaps")), 20, "n", "domain")


_SQL_DEGREES = "ic AS (SELECT to_url AS u, count(*) AS n FROM ed GROUP BY 1), oc AS (SELECT from_url AS u, count(*) AS n FROM ed GROUP BY 1), dg AS (SELECT final_url AS url, coalesce(ic.n, 0) AS n_in, coalesce(oc.n, 0) AS n_out FROM p LEFT JOIN ic ON ic.u = final_url LEFT JOIN oc ON oc.u = final_url)"


def degrees(s: Site) -> DataFrame:
    """Links are counted at both their ends in one aggregate."""
    ends = s.edges.select(F.explode(F.array(F.struct(F.col("to_url").alias("url"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("from_url").alias("url"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    linked = ends.groupBy("url").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return s.pages.select(F.col("final_url").alias("url")).join(linked, "url", "left").fillna(0)


@query("audit_link_distribution", f"SELECT count(*) AS pages, count(*) FILTER (n_in = 0) AS unlinked, count(*) FILTER (n_in >= 5 AND n_out <= 1) AS sinks, {near('avg(n_in)')} AS mean_in, list_sort(list(n_in))[count(*) // 2 + 1] AS median_in FROM dg", _SQL_DEGREES)
def audit_link_distribution(s: Site) -> DataFrame:
    # counts of each pair of degrees, written once: the sums and the median are of them, not of the pages
    pairs = frames.written(counts(degrees(s), "n_in", "n_out", name="k"))
    sums = pairs.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("pages"), F.coalesce(F.sum(F.when(F.col("n_in") == 0, F.col("k"))), F.lit(0)).alias("unlinked"), F.coalesce(F.sum(F.when((F.col("n_in") >= 5) & (F.col("n_out") <= 1), F.col("k"))), F.lit(0)).alias("sinks"), rounded(F.sum(F.col("n_in") * F.col("k")) / F.sum("k")).alias("mean_in"))
    median = frames.selected(pairs.groupBy("n_in").agg(F.sum("k").alias("k")).withColumn("all", F.lit(1)), "n_in", "all", lambda n: F.floor(n / 2), "median_in", times="k")
    return sums.join(F.broadcast(median.select("median_in")), how="left")


@query("audit_link_top", "SELECT url, n_in FROM dg ORDER BY n_in DESC, url LIMIT 30", _SQL_DEGREES)
def audit_link_top(s: Site) -> DataFrame:
    return degrees(s).select("url", "n_in").orderBy(F.desc("n_in"), "url").limit(30)


@query("audit_images", f"SELECT domain, count(*) AS pages, CAST(sum({integer('img_missing_alt_count')}) AS BIGINT) AS missing, CAST(sum({integer('img_count')}) AS BIGINT) AS images, {pct(f'sum({integer("img_missing_alt_count")})', f'sum({integer("img_count")})')} AS pct_missing FROM p WHERE {integer('img_missing_alt_count')} > 0 GROUP BY 1 ORDER BY missing DESC, domain LIMIT 20")
def audit_images(s: Site) -> DataFrame:
    affected = s.pages.where(as_int("img_missing_alt_count") > 0)
    missing, images = F.sum(as_int("img_missing_alt_count")), F.sum(as_int("img_count"))
    return top(affected.groupBy("domain").agg(F.count("*").alias("pages"), missing.alias("missing"), images.alias("images"), share(missing, images).alias("pct_missing")), 20, "missing", "domain")


@query("audit_images_summary", f"SELECT pages, images, missing, pct_missing, {sql_severity('CASE WHEN images > 0 THEN 100.0 * missing / images ELSE 0 END')} AS severity FROM (SELECT count(*) FILTER ({integer('img_missing_alt_count')} > 0) AS pages, CAST(sum({integer('img_count')}) AS BIGINT) AS images, CAST(sum({integer('img_missing_alt_count')}) AS BIGINT) AS missing, {pct(f'sum({integer("img_missing_alt_count")})', f'sum({integer("img_count")})')} AS pct_missing FROM p)")
def audit_images_summary(s: Site) -> DataFrame:
    """The severity is of images, not of pages."""
    missing, images = F.sum(as_int("img_missing_alt_count")), F.sum(as_int("img_count"))
    rows = s.pages.agg(F.count_if(as_int("img_missing_alt_count") > 0).alias("pages"), images.alias("images"), missing.alias("missing"), share(missing, images).alias("pct_missing"))
    return rows.withColumn("severity", severity(F.when(F.col("images") > 0, 100.0 * F.col("missing") / F.col("images")).otherwise(F.lit(0.0))))


@query("audit_image_pages", f"SELECT final_url AS url, domain, {integer('img_count')} AS images, {integer('img_missing_alt_count')} AS missing, {pct(integer('img_missing_alt_count'), integer('img_count'))} AS pct_missing FROM p WHERE {integer('img_missing_alt_count')} > 0 ORDER BY missing DESC, url LIMIT 100")
def audit_image_pages(s: Site, cap: int | None = 100) -> DataFrame:
    rows = s.pages.select(F.col("final_url").alias("url"), "domain", as_int("img_count").alias("images"), as_int("img_missing_alt_count").alias("missing")).where("missing > 0")
    return capped(rows.withColumn("pct_missing", share(F.col("missing"), F.col("images"))).orderBy(F.desc("missing"), "url", "domain", "images"), cap)


_SQL_SEGMENTS = "len(list_filter(string_split(regexp_extract(final_url, '^(?:[a-z]+://[^/?#]*)?([^?#]*)', 1), '/'), lambda x: x <> ''))"


@query("audit_urls", f"SELECT 'depth' AS measure, CAST({_SQL_SEGMENTS} AS BIGINT) AS bucket, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT 'length', CAST(length(final_url) // 25 * 25 AS BIGINT), count(*) FROM p GROUP BY ALL")
def audit_urls(s: Site) -> DataFrame:
    depth = F.size(F.filter(F.split(urls.path("final_url"), "/"), lambda x: x != "")).cast("long")
    length = (F.floor(F.length("final_url") / 25) * 25).cast("long")
    rows = s.pages.select(F.explode(F.array(F.struct(F.lit("depth").alias("measure"), depth.alias("bucket")), F.struct(F.lit("length").alias("measure"), length.alias("bucket")))).alias("x"))
    return counts(rows, "x.measure", "x.bucket")


@query("audit_deep_urls", f"SELECT final_url AS url, domain, CAST({_SQL_SEGMENTS} AS INT) AS depth FROM p WHERE {_SQL_SEGMENTS} >= 5 ORDER BY depth DESC, url LIMIT 50")
def audit_deep_urls(s: Site, least: int = 5, cap: int | None = 50) -> DataFrame:
    depth = F.size(F.filter(F.split(urls.path("final_url"), "/"), lambda x: x != ""))
    return capped(s.pages.select(F.col("final_url").alias("url"), "domain", depth.alias("depth")).where(F.col("depth") >= least).orderBy(F.desc("depth"), "url"), cap)


@query("url_parameters", "SELECT k AS param, count(*) AS n FROM (SELECT unnest(list_distinct(list_transform(list_filter(string_split(regexp_extract(final_url, '^[^#?]*[?]([^#]*)', 1), '&'), lambda x: regexp_matches(x, '^[^=]+=.')), lambda x: split_part(x, '=', 1)))) AS k FROM p) GROUP BY 1 ORDER BY n DESC, param LIMIT 20")
def url_parameters(s: Site) -> DataFrame:
    pairs = F.filter(F.split(urls.query("final_url"), "&"), lambda x: x.rlike("^[^=]+=."))
    names = F.array_distinct(F.transform(pairs, lambda x: F.split_part(x, F.lit("="), F.lit(1))))
    return top(counts(s.pages.select(F.explode(names).alias("param")), "param"), 20, "n", "param")


def _sql_year(c: str) -> str:
    return f"try_cast(substr(regexp_extract({c}, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), 1, 4) AS INT)"


_SQL_DECAY = f"dc AS (SELECT *, 2025 - {_sql_year('date_published')} AS age, 2025 - {_sql_year('date_modified')} AS since FROM p WHERE trim(date_published) <> ''), df AS (SELECT *, trim(date_modified) = '' AS never, coalesce(age >= 3 AND (trim(date_modified) = '' OR since >= 2), FALSE) AS stale FROM dc)"


def _dated(c: str) -> Column:
    """The year of the first whole date of a cell."""
    return F.regexp_extract(c, "([0-9]{4})-[0-9]{2}-[0-9]{2}", 1).try_cast("int")


def decay(s: Site, as_of: int = 2025) -> DataFrame:
    rows = s.pages.where(filled("date_published"))
    age, since, never = as_of - _dated("date_published"), as_of - _dated("date_modified"), ~filled("date_modified")
    return rows.select("domain", never.alias("never"), F.coalesce((age >= 3) & (never | (since >= 2)), F.lit(False)).alias("stale"))


@query("audit_decay", "SELECT domain, count(*) FILTER (never OR stale) AS findings, count(*) FILTER (never) AS never_updated, count(*) FILTER (stale) AS stale FROM df GROUP BY 1", _SQL_DECAY)
def audit_decay(s: Site) -> DataFrame:
    return decay(s).groupBy("domain").agg(F.count_if(F.col("never") | F.col("stale")).alias("findings"), F.count_if("never").alias("never_updated"), F.count_if("stale").alias("stale"))


@query("audit_errors", f"SELECT * FROM (SELECT 'type' AS by_what, error_type AS value, count(*) AS n FROM er GROUP BY ALL ORDER BY n DESC, value LIMIT 10) UNION ALL SELECT * FROM (SELECT 'host', {host('url')} AS v, count(*) AS n FROM er GROUP BY ALL ORDER BY n DESC, v LIMIT 20) UNION ALL SELECT * FROM (SELECT 'status', trim(http_status) AS v, count(*) AS n FROM er WHERE trim(http_status) NOT IN ('', '0') GROUP BY ALL ORDER BY n DESC, v LIMIT 10)")
def audit_errors(s: Site) -> DataFrame:
    def ranked(what: str, value: Column, n: int, rows: DataFrame) -> DataFrame:
        return top(counts(rows, F.lit(what).alias("by_what"), value.alias("value")), n, "n", "value")

    failed = s.errors.where(~F.trim(text("http_status")).isin("", "0"))
    return ranked("type", F.col("error_type"), 10, s.errors).union(ranked("host", urls.host("url"), 20, s.errors)).union(ranked("status", F.trim("http_status"), 10, failed))


_SQL_TALLY = f"""ty AS (SELECT audit, n, total, {sql_severity('share')} AS severity FROM (
SELECT 'duplicate_content' AS audit, (SELECT count(*) FROM du) AS n, (SELECT 100.0 * sum(least(n, 20)) FROM du) / t.total AS share, t.total FROM t
UNION ALL SELECT 'redirects', (SELECT count(*) FROM rd), 100.0 * (SELECT count(*) FROM rd) / total, total FROM t
UNION ALL SELECT 'thin_content', (SELECT count(*) FROM th), 100.0 * (SELECT count(*) FROM th) / total, total FROM t
UNION ALL SELECT 'title_meta', (SELECT count(*) FROM tm), 100.0 * (SELECT count(*) FROM tm) / total, total FROM t
UNION ALL SELECT 'orphan_pages', (SELECT count(*) FROM op), 100.0 * (SELECT count(*) FROM op) / total, total FROM t
UNION ALL SELECT 'link_distribution', (SELECT count(DISTINCT url) FROM dg WHERE n_in = 0), 100.0 * (SELECT count(DISTINCT url) FROM dg WHERE n_in = 0) / total, total FROM t
UNION ALL SELECT 'image_accessibility', (SELECT count(*) FROM p WHERE {integer('img_missing_alt_count')} > 0), (SELECT 100.0 * sum({integer('img_missing_alt_count')}) / sum({integer('img_count')}) FROM p), total FROM t
UNION ALL SELECT 'url_structure', (SELECT count(*) FROM p WHERE {_SQL_SEGMENTS} >= 5), 100.0 * (SELECT count(*) FROM p WHERE {_SQL_SEGMENTS} >= 5) / total, total FROM t
UNION ALL SELECT 'content_decay', (SELECT count(*) FROM df WHERE never OR stale), 100.0 * (SELECT count(*) FROM df WHERE stale) / total, total FROM t
UNION ALL SELECT 'broken_links', (SELECT count(*) FROM er), 100.0 * (SELECT count(*) FROM er) / total, total FROM t))"""
_TALLY = (
    SQL_THIN,
    _SQL_ORPHANS,
    _SQL_REDIRECTS,
    _SQL_DECAY,
    _SQL_REPEATED,
    _SQL_DEGREES,
    "t AS (SELECT count(*) AS total FROM p)",
    "tm AS (SELECT 1 FROM p WHERE length(trim(title)) NOT BETWEEN 30 AND 60 OR length(trim(meta_description)) NOT BETWEEN 70 AND 160)",
    _SQL_TALLY,
)


@query("audit_summary", "SELECT * FROM ty", *_TALLY)
def audit_summary(s: Site, as_of: int = 2025) -> DataFrame:
    """The ten audits with their findings and severities. What follows from pages alone is one aggregation over them."""
    depth = F.size(F.filter(F.split(urls.path("final_url"), "/"), lambda x: x != ""))
    size = lambda c: F.length(F.trim(c))
    words, age, since, never = as_int("word_count"), as_of - _dated("date_published"), as_of - _dated("date_modified"), ~filled("date_modified")
    stale = filled("date_published") & F.coalesce((age >= 3) & (never | (since >= 2)), F.lit(False))
    missing = as_int("img_missing_alt_count")
    tests = {
        "redirects": filled("final_url") & (F.col("requested_url") != F.col("final_url")),
        "thin_content": (words < 50) | ~filled("heading_outline") | (as_int("link_count_internal") == 0),
        "title_meta": ~size("title").between(30, 60) | ~size("meta_description").between(70, 160),
        "image_accessibility": missing > 0,
        "url_structure": depth >= 5,
        "content_decay": filled("date_published") & (never | stale),
    }
    facts = s.pages.agg(F.count("*").alias("total"), *(F.count_if(t).alias(k) for k, t in tests.items()), F.count_if(stale).alias("stale"), F.sum(missing).alias("missing"), F.sum(as_int("img_count")).alias("images"))
    groups = repeated(s).agg(F.count("*").alias("duplicate_content"), F.coalesce(F.sum(F.least("n", F.lit(20))), F.lit(0)).alias("affected"))
    linked = s.edges.select(F.col("to_url").alias("final_url")).distinct()
    bare = s.pages.where("final_url <> ''").join(linked, "final_url", "left_anti").agg(F.count("*").alias("orphan_pages"), F.count_distinct("final_url").alias("unlinked"))
    blank = s.pages.where("final_url = ''").agg((F.count("*") > 0).cast("long").alias("blank"))
    errors = s.errors.agg(F.count("*").alias("broken_links"))
    one = facts.join(F.broadcast(groups)).join(F.broadcast(bare)).join(F.broadcast(blank)).join(F.broadcast(errors))
    of_pages = lambda c: 100.0 * F.col(c) / F.col("total")
    one = one.withColumn("link_distribution", F.col("unlinked") + F.col("blank"))
    rows = [("duplicate_content", of_pages("affected")), *((k, of_pages(k)) for k in ("redirects", "thin_content", "title_meta", "orphan_pages", "link_distribution")), ("image_accessibility", 100.0 * F.col("missing") / F.col("images")), ("url_structure", of_pages("url_structure")), ("content_decay", of_pages("stale")), ("broken_links", of_pages("broken_links"))]
    tally = F.array(*(F.struct(F.lit(k).alias("audit"), F.col(k).alias("n"), F.coalesce(x, F.lit(0.0)).alias("share")) for k, x in rows))
    return one.select("total", F.explode(tally).alias("x")).select("x.audit", "x.n", "total", severity(F.col("x.share")).alias("severity"))


@query("audit_tally", "SELECT count(*) AS checks, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, CAST(sum(n) AS BIGINT) AS findings FROM ty", *_TALLY)
def audit_tally(s: Site) -> DataFrame:
    return audit_summary(s).agg(F.count("*").alias("checks"), *(F.count_if(F.col("severity") == x).alias(x) for x in ("high", "medium", "low")), F.sum("n").alias("findings"))


# Accessibility: pages of all runs, unmerged. A blank share counts as 0 and fails.

_SQL_ONE = lambda c: f"{c} = '1'"
_SQL_NONE = lambda c: f"{integer(c)} = 0"
_one = lambda c: text(c) == "1"
_no = lambda c: as_int(c) == 0
#: Criterion: principle, level, test of a page, and the test in SQL.
CRITERIA: dict[str, tuple[str, str, Callable[[], Column], str]] = {
    "1.1.1": ("perceivable", "A", lambda: (as_float("wcag_img_alt_pct") >= 1.0) | _no("img_count"), f"({real('wcag_img_alt_pct')} >= 1.0 OR {_SQL_NONE('img_count')})"),
    "1.3.1a": ("perceivable", "A", lambda: _one("wcag_heading_order_valid"), _SQL_ONE("wcag_heading_order_valid")),
    "1.3.1b": ("perceivable", "A", lambda: as_float("wcag_form_labels_pct") >= 1.0, f"{real('wcag_form_labels_pct')} >= 1.0"),
    "1.3.1c": ("perceivable", "A", lambda: _no("wcag_tables_no_headers"), _SQL_NONE("wcag_tables_no_headers")),
    "1.3.5": ("perceivable", "AA", lambda: as_float("wcag_autocomplete_pct") >= 1.0, f"{real('wcag_autocomplete_pct')} >= 1.0"),
    "2.4.1": ("operable", "A", lambda: _one("wcag_landmarks_present"), _SQL_ONE("wcag_landmarks_present")),
    "2.4.2": ("operable", "A", lambda: _one("wcag_title_present"), _SQL_ONE("wcag_title_present")),
    "2.4.4": ("operable", "A", lambda: as_float("wcag_vague_link_pct") <= 0.05, f"{real('wcag_vague_link_pct')} <= 0.05"),
    "2.4.5": ("operable", "AA", lambda: _one("wcag_has_nav") | _one("wcag_has_search"), f"({_SQL_ONE('wcag_has_nav')} OR {_SQL_ONE('wcag_has_search')})"),
    "2.4.6": ("operable", "AA", lambda: _no("wcag_empty_headings"), _SQL_NONE("wcag_empty_headings")),
    "3.1.1": ("understandable", "A", lambda: _one("wcag_lang_valid"), _SQL_ONE("wcag_lang_valid")),
    "4.1.1": ("robust", "A", lambda: _no("wcag_duplicate_ids"), _SQL_NONE("wcag_duplicate_ids")),
    "4.1.2": ("robust", "A", lambda: _no("wcag_empty_buttons") & _no("wcag_empty_links"), f"({_SQL_NONE('wcag_empty_buttons')} AND {_SQL_NONE('wcag_empty_links')})"),
}
_SQL_CRITERIA = "wc AS (" + " UNION ALL ".join(f"SELECT '{k}' AS criterion, '{p}' AS principle, '{lv}' AS level, domain, final_url AS url, {q} AS passed FROM pages_raw" for k, (p, lv, _, q) in CRITERIA.items()) + ")"


def checked(s: Site) -> DataFrame:
    """A row for each page and criterion, in one pass."""
    facts = F.array(*(F.struct(F.lit(k).alias("criterion"), F.lit(p).alias("principle"), F.lit(lv).alias("level"), test().alias("passed")) for k, (p, lv, test, _) in CRITERIA.items()))
    return s.estate.pages_raw.select("domain", F.col("final_url").alias("url"), F.explode(facts).alias("c")).select("domain", "url", "c.*")


@query("wcag_criteria", f"SELECT criterion, principle, level, count(*) AS total, count(*) FILTER (passed) AS passes, {pct('count(*) FILTER (passed)', 'count(*)')} AS pct, CASE WHEN count(*) = count(*) FILTER (passed) THEN 'pass' WHEN {pct('count(*) FILTER (passed)', 'count(*)')} >= 80 THEN 'partial' ELSE 'fail' END AS status FROM wc GROUP BY ALL", _SQL_CRITERIA)
def wcag_criteria(s: Site) -> DataFrame:
    rows = checked(s).groupBy("criterion", "principle", "level").agg(F.count("*").alias("total"), F.count_if("passed").alias("passes"))
    rows = rows.withColumn("pct", share(F.col("passes"), F.col("total")))
    return rows.withColumn("status", F.when(F.col("passes") == F.col("total"), "pass").when(F.col("pct") >= 80, "partial").otherwise("fail"))


@query("wcag_principles", "SELECT principle, level, count(*) AS checks, count(*) FILTER (passed) AS passes FROM wc GROUP BY ALL", _SQL_CRITERIA)
def wcag_principles(s: Site) -> DataFrame:
    return checked(s).groupBy("principle", "level").agg(F.count("*").alias("checks"), F.count_if("passed").alias("passes"))


@query("wcag_domains", "SELECT domain, count(*) AS failures FROM (SELECT *, row_number() OVER (PARTITION BY criterion ORDER BY url, domain) AS k FROM wc WHERE NOT passed) WHERE k <= 50 GROUP BY 1", _SQL_CRITERIA)
def wcag_domains(s: Site) -> DataFrame:
    """By domain, from each criterion's first 50 failures."""
    failing = checked(s).where("not passed")
    ranked = F.row_number().over(frames.Window.partitionBy("criterion").orderBy("url", "domain"))
    return counts(failing.withColumn("k", ranked).where("k <= 50"), "domain", name="failures")


# Runs

BREAKDOWNS = {"domain": ("domain", "unknown"), "status": ("http_status", ""), "kind": ("content_kind_guess", "(unclassified)"), "lang": ("lang", "(not set)")}
_SQL_DIGITS = lambda c: f"CAST(coalesce(sum(CASE WHEN regexp_full_match({c}, '[0-9]+') THEN CAST({c} AS BIGINT) END), 0) AS BIGINT)"


@query(
    "run_metrics",
    "SELECT run, breakdown, value, n FROM (SELECT *, row_number() OVER (PARTITION BY run, breakdown ORDER BY n DESC, value) AS k FROM (SELECT run, breakdown, value, CAST(sum(n) AS BIGINT) AS n FROM ("
    + " UNION ALL ".join(f"SELECT run, '{k}' AS breakdown, CASE WHEN trim({c}) = '' THEN '{d}' ELSE trim({c}) END AS value, count(*) AS n FROM pages_raw GROUP BY ALL" for k, (c, d) in BREAKDOWNS.items())
    + " UNION ALL SELECT run, 'status', trim(http_status), count(*) FROM errors WHERE trim(http_status) NOT IN ('', '0') GROUP BY ALL UNION ALL SELECT run, 'asset', category, count(*) FROM assets GROUP BY ALL UNION ALL SELECT run, 'error', error_type, count(*) FROM errors GROUP BY ALL) GROUP BY ALL)) WHERE breakdown <> 'domain' OR k <= 15",
)
def run_metrics(s: Site) -> DataFrame:
    """Of each run, unmerged: pages by domain (the 15 biggest), status (errors' too), kind and language; assets by category; errors
    by type."""
    pairs = F.array(*(F.struct(F.lit(k).alias("breakdown"), F.when(filled(c), F.trim(c)).otherwise(F.lit(d)).alias("value")) for k, (c, d) in BREAKDOWNS.items()))
    rows = s.estate.pages_raw.select("run", F.explode(pairs).alias("x")).select("run", "x.*")
    failed = s.estate.errors.select("run", F.lit("status"), F.trim("http_status").alias("v")).where("v not in ('', '0')")
    rows = rows.union(failed).union(s.estate.assets.select("run", F.lit("asset"), "category")).union(s.estate.errors.select("run", F.lit("error"), "error_type"))
    found = counts(rows, "run", "breakdown", "value")
    biggest = F.row_number().over(frames.Window.partitionBy("run").orderBy(F.desc("n"), "value"))
    domains = found.where("breakdown = 'domain'").withColumn("k", biggest).where("k <= 15").drop("k")
    return found.where("breakdown <> 'domain'").unionByName(domains)


@query(
    "run_totals",
    f"""SELECT r.run, pages, domains, avg_words, images, missing, training, coalesce(a.n, 0) AS assets, coalesce(e.n, 0) AS errors, coalesce(l.n, 0) AS links, coalesce(t.n, 0) AS tags FROM (SELECT run, count(*) AS pages, count(DISTINCT CASE WHEN domain = '' THEN 'unknown' ELSE domain END) AS domains, CAST(round_even(CAST({_SQL_DIGITS('word_count')} AS DOUBLE) / count(*), 0) AS BIGINT) AS avg_words, {_SQL_DIGITS('img_count')} AS images, {_SQL_DIGITS('img_missing_alt_count')} AS missing, count(*) FILTER (trim(training_related_flag) <> '') AS training FROM pages_raw GROUP BY 1) r
LEFT JOIN (SELECT run, count(*) AS n FROM assets GROUP BY 1) a ON a.run = r.run LEFT JOIN (SELECT run, count(*) AS n FROM errors GROUP BY 1) e ON e.run = r.run LEFT JOIN (SELECT run, count(*) AS n FROM edges GROUP BY 1) l ON l.run = r.run LEFT JOIN (SELECT run, count(*) AS n FROM tags GROUP BY 1) t ON t.run = r.run""",
)
def run_totals(s: Site) -> DataFrame:
    """Of each run, unmerged; only runs of digits count as numbers."""
    digits = lambda c: F.coalesce(F.sum(F.when(text(c).rlike("^[0-9]+$"), F.col(c).try_cast("long"))), F.lit(0))
    n = F.count("*")
    rows = s.estate.pages_raw.groupBy("run").agg(
        n.alias("pages"),
        F.count_distinct(F.when(F.col("domain") == "", F.lit("unknown")).otherwise(F.col("domain"))).alias("domains"),
        F.rint(digits("word_count") / n).cast("long").alias("avg_words"),
        digits("img_count").alias("images"),
        digits("img_missing_alt_count").alias("missing"),
        F.count_if(filled("training_related_flag")).alias("training"),
    )
    for name, table in (("assets", s.estate.assets), ("errors", s.estate.errors), ("links", s.estate.edges), ("tags", s.estate.tags)):
        rows = rows.join(counts(table, "run", name=name), "run", "left")
    return rows.fillna(0, ["assets", "errors", "links", "tags"])


@query("project_overview", f"SELECT run, count(*) AS pages, count(DISTINCT domain) AS domains, CAST(sum(CASE WHEN regexp_full_match(word_count, '[0-9]+') THEN CAST(word_count AS BIGINT) ELSE 0 END) AS BIGINT) AS words, (SELECT count(*) FROM errors e WHERE e.run = pages_raw.run) AS errors FROM pages_raw GROUP BY run")
def project_overview(s: Site) -> DataFrame:
    """Per run, unmerged; only runs of digits count as numbers."""
    words = F.when(text("word_count").rlike("^[0-9]+$"), F.col("word_count").try_cast("long")).otherwise(F.lit(0).cast("long"))
    pages = s.estate.pages_raw.groupBy("run").agg(F.count("*").alias("pages"), F.count_distinct("domain").alias("domains"), F.sum(words).alias("words"))
    return pages.join(counts(s.estate.errors, "run", name="errors"), "run", "left").fillna(0)


_COVERED = FIELDS["pages"]


@query("field_coverage", "SELECT CASE WHEN trim(tech_stack_detected) = '' THEN 'static/unknown' ELSE trim(tech_stack_detected) END AS tech_stack, count(*) AS total_pages, " + ", ".join(f"{near(f'100.0 * count(*) FILTER (trim({c}) NOT IN ({chr(39) * 2}, {chr(39)}0{chr(39)})) / count(*)')} AS {c}" for c in _COVERED) + " FROM pages_raw GROUP BY 1")
def field_coverage(s: Site, columns: tuple[str, ...] = _COVERED) -> DataFrame:
    """How often each column of pages is filled, by system; one pass whatever the number of columns."""
    filled_in = lambda c: ~F.trim(text(c)).isin("", "0")
    stack = F.when(filled("tech_stack_detected"), F.trim("tech_stack_detected")).otherwise(F.lit("static/unknown"))
    return s.estate.pages_raw.groupBy(stack.alias("tech_stack")).agg(F.count("*").alias("total_pages"), *(rounded(100.0 * F.count_if(filled_in(c)) / F.count("*")).alias(c) for c in columns))


# Columns whose gaps are fetched again.
_GAPS = ("author", "publisher", "json_ld_id", "cms_generator", "microdata_types", "rdfa_types", "breadcrumb_schema", "extraction_coverage_pct", "extraction_coverage_core_pct", "hreflang_links", "feed_urls")


@query("gap_refetch", "SELECT requested_url AS url, min(seq) AS seq FROM pages_raw WHERE run = '" + RUNS[0] + "' AND trim(requested_url) <> '' AND (trim(author) = '' OR trim(publisher) = '' OR trim(json_ld_id) = '' OR trim(cms_generator) = '' OR trim(microdata_types) = '' OR trim(rdfa_types) = '' OR trim(breadcrumb_schema) = '' OR trim(extraction_coverage_pct) = '' OR trim(extraction_coverage_core_pct) = '' OR trim(hreflang_links) = '' OR trim(feed_urls) = '') GROUP BY 1")
def gap_refetch(s: Site, columns: tuple[str, ...] = _GAPS) -> DataFrame:
    """URLs with a gap in any of the columns, in their first order; columns that don't exist are passed over."""
    rows = s.estate.of_runs(RUNS[0]).pages_raw
    return rows.where(filled("requested_url") & frames._either(~filled(c) for c in columns if c in rows.columns)).groupBy(F.col("requested_url").alias("url")).agg(F.min("seq").alias("seq"))


@query("gap_refetch_titles", "SELECT requested_url AS url, min(seq) AS seq FROM pages_raw WHERE run = '" + RUNS[0] + "' AND trim(title) = '' GROUP BY 1")
def gap_refetch_titles(s: Site) -> DataFrame:
    """Columns of one's own."""
    return gap_refetch(s, ("title", "no_such_column"))


@query("csv_page", "SELECT seq, requested_url FROM pages_raw WHERE run = '" + RUNS[0] + "' ORDER BY seq LIMIT 20 OFFSET 40")
def csv_page(s: Site) -> DataFrame:
    return frames.page(s.estate.of_runs(RUNS[0]).pages_raw, 3, 20, "seq").select("seq", "requested_url")


@query("pick_diverse", "SELECT url, seq FROM (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY seq) AS turn, min(seq) OVER (PARTITION BY seg) AS seen FROM (SELECT page_id AS seq, url, split_part(concat(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '/', 2) AS seg FROM pages)) ORDER BY turn, seen, seq LIMIT 25")
def pick_diverse(s: Site) -> DataFrame:
    return frames.pick_diverse(s.table("pages").select(F.col("page_id").alias("seq"), "url"), 25).select("url", "seq")


# Merges, restrictions and filters


def _merged(name: str, table: str, columns: tuple[str, ...], frame):
    query(name, f"SELECT {', '.join(columns)} FROM {table}")(lambda s: frame(s).select(*columns))


_merged("merge_pages", "p", ("run", "seq", "requested_url", "title"), lambda s: s.pages)
_merged("merge_edges", "ed", ("run", "seq", "from_url", "to_url", "link_text"), lambda s: s.edges)
_merged("merge_tags", "tg", ("run", "seq", "page_url", "tag_value"), lambda s: s.tags)
_merged("merge_nav", "nv", ("run", "seq", "page_url", "nav_href", "nav_text"), lambda s: s.nav)
_merged("merge_assets", "ast", ("run", "seq", "referrer_page_url", "asset_url", "category"), lambda s: s.assets)
_merged("merge_errors", "er", ("run", "seq", "url", "error_type"), lambda s: s.errors)
_merged("single_run", f"(SELECT * FROM pages_raw WHERE run = '{RUNS[1]}')", ("run", "seq", "requested_url"), lambda s: frames.merge_pages(s.estate.of_runs(RUNS[1]).pages_raw, runs=1))

_FILTERS: dict[str, tuple[dict, str]] = {
    "filter_cms": ({"cms": ["wordpress", "shop"]}, "(contains(lower(cms_generator), 'wordpress') OR contains(lower(cms_generator), 'shop'))"),
    "filter_kinds": ({"content_kinds": ["product"]}, "lower(trim(content_kind_guess)) = 'product'"),
    "filter_schema_formats": ({"schema_formats": ["microdata", "rdfa"]}, "(trim(microdata_types) <> '' OR trim(rdfa_types) <> '')"),
    "filter_schema_types": ({"schema_types": ["article", "offer"]}, "(contains(lower(concat_ws('|', json_ld_types, microdata_types, rdfa_types)), 'article') OR contains(lower(concat_ws('|', json_ld_types, microdata_types, rdfa_types)), 'offer'))"),
    "filter_dates": ({"date_from": "2022-01-01", "date_to": "2022-12-31"}, "(trim(date_published) >= '2022-01-01' OR trim(date_modified) >= '2022-01-01') AND (substr(trim(date_published), 1, 10) <= '2022-12-31' OR substr(trim(date_modified), 1, 10) <= '2022-12-31')"),
    "filter_coverage": ({"min_coverage": 50.0}, f"{real('extraction_coverage_pct')} >= 50"),
    "filter_combined": ({"cms": ["drupal"], "content_kinds": ["blog", "news"], "min_coverage": 20.0}, f"contains(lower(cms_generator), 'drupal') AND lower(trim(content_kind_guess)) IN ('blog', 'news') AND {real('extraction_coverage_pct')} >= 20"),
    "filter_domains": ({"domains": ["blog.ththan.example.net", "WWW.ththwh.example.org"]}, "lower(domain) IN ('blog.ththan.example.net', 'www.ththwh.example.org')"),
}
for _name, (_given, _where) in _FILTERS.items():
    query(_name, f"SELECT run, seq, domain FROM p WHERE {_where}")(lambda s, given=_given: frames.filter_pages(s.pages, **given).select("run", "seq", "domain"))

_SQL_KNOWN = "kn AS (SELECT final_url AS u FROM p WHERE contains(lower(cms_generator), 'drupal') UNION SELECT requested_url FROM p WHERE contains(lower(cms_generator), 'drupal'))"


@query("restrict_tags", "SELECT seq, page_url, tag_value FROM tg WHERE page_url IN (SELECT u FROM kn WHERE u <> '')", _SQL_KNOWN)
def restrict_tags(s: Site) -> DataFrame:
    return frames.restrict(s.tags, "page_url", frames.filter_pages(s.pages, cms=["drupal"])).select("seq", "page_url", "tag_value")


@query("restrict_by_no_pages", "SELECT seq, page_url, tag_value FROM tg")
def restrict_by_no_pages(s: Site) -> DataFrame:
    return frames.restrict(s.tags, "page_url", s.pages.where("false")).select("seq", "page_url", "tag_value")


# Frontier


@query("frontier_bfs", "SELECT url, min(depth) AS depth FROM bf GROUP BY 1", "seeds AS (SELECT url FROM base WHERE i < 3)", "bf AS (SELECT url, 0 AS depth FROM seeds UNION SELECT e.to_url, depth + 1 FROM bf JOIN edges e ON e.from_url = bf.url WHERE depth < 4)")
def frontier_bfs(s: Site) -> DataFrame:
    return frames.reachable(s.estate.edges, s.table("pages").where("page_id < 3").select("url"), 4)


ORACLE_SQL["frontier_bfs"] = ORACLE_SQL["frontier_bfs"].replace("WITH ", "WITH RECURSIVE ", 1)


_SQL_KEY = "regexp_replace(concat('https://', lower(regexp_extract(u, '://([^/?#]*)', 1)), CASE WHEN regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1) END, CASE WHEN regexp_extract(u, '^[^#?]*[?]([^#]*)', 1) = '' THEN '' ELSE concat('?', array_to_string(list_sort(string_split(regexp_extract(u, '^[^#?]*[?]([^#]*)', 1), '&')), '&')) END), '/+$', '')"


@query("visited_union", f"SELECT DISTINCT {_SQL_KEY} AS k FROM (SELECT trim(requested_url) AS u FROM pages_raw UNION SELECT trim(url) FROM errors) WHERE u <> ''")
def visited_union(s: Site) -> DataFrame:
    """Crawl keys of what runs have tried."""
    tried = s.estate.pages_raw.select(F.trim("requested_url").alias("u")).union(s.estate.errors.select(F.trim("url")))
    return tried.where("u <> ''").select(urls.crawl_key("u").alias("k")).distinct()


@query("scope_filter", f"SELECT url FROM base WHERE ({host('url')} = 'example.com' OR ends_with({host('url')}, '.example.com') OR ends_with({host('url')}, '.example.org')) AND NOT ({host('url')} = 'spam-farm.example.org' OR ends_with({host('url')}, '.spam-farm.example.org')) AND NOT contains(lower(url), 'utm_') AND (contains(lower(url), '/en/') OR contains(lower(url), '/de/'))")
def scope_filter(s: Site) -> DataFrame:
    return s.table("pages").where(urls.in_scope("url", [".example.com", "example.org"], ["spam-farm.example.org"], ["utm_"], ["/en/", "/de/"])).select("url")
