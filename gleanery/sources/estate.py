"""The engine's tables from the driver's: real values where the tables have them, the rest by integer arithmetic on ids,
so that every column has blanks, ties, repeats and cells that don't parse. The statements run on Spark and on DuckDB.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gleanery.session import ship_package


def pick(key: str, *values: str) -> str:
    """One of the values by the key."""
    return f"CASE ({key}) % {len(values)} " + " ".join(f"WHEN {n} THEN '{v}'" for n, v in enumerate(values)) + " END"


def number(key: str, most: int, after: str = "") -> str:
    return f"concat(CAST(({key}) % {most} AS STRING), '{after}')"


def day(key: str) -> str:
    """2019 to 2024, as text."""
    return f"concat(CAST(2019 + ({key}) % 6 AS STRING), '-0', CAST(1 + ({key}) % 9 AS STRING), '-1', CAST(({key}) % 10 AS STRING))"


RUNS = ("run_2024-01-01", "run_2024-02-01")

_BASE = """SELECT page_id AS i, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) AS size FROM pages"""

_PAGES = {
    "requested_url": "url",
    "final_url": "CASE WHEN i % 13 = 0 THEN concat(url, '-moved') WHEN i % 29 = 0 THEN concat('https://other.example.org/', CAST(i AS STRING)) WHEN i % 31 = 0 THEN '' ELSE url END",
    "domain": "host",
    "http_status": pick("i", "200", "200", "200", "301", "404"),
    "title": f"CASE WHEN i % 23 = 0 THEN '' WHEN i % 20 = 8 THEN 'Summer Sale and Wholesale' WHEN i % 20 = 16 THEN 'Saved clearances' WHEN r = 1 THEN concat(title, ' v2') WHEN i % 9 = 0 THEN {pick('i', 'Home', 'Welcome to the site', 'News')} ELSE title END",
    "meta_description": f"CASE WHEN i % 5 = 0 THEN '' WHEN i % 3 = 0 THEN {pick('i', 'Short.', 'A description that is long enough to be useful to those who read it in a list of results.', 'Same words')} ELSE concat(title, ' ', title, ' ', title, ' ', title) END",
    "og_type": pick("i", "", "website", "article", "product"),
    "h1_joined": "CASE WHEN i % 11 = 0 THEN '' ELSE title END",
    "heading_outline": pick("i", "H2:One|H3:Two", "", "H2:Only", ""),
    "content_kind_guess": pick("i", "blog", "product", "", "news", "homepage", "Product", "unknown"),
    "word_count": f"CASE WHEN i % 17 = 0 THEN '' WHEN i % 19 = 0 THEN 'n/a' ELSE {number('i * 37', 600)} END",
    "img_count": number("i", 7),
    "img_missing_alt_count": f"CASE WHEN i % 7 = 0 THEN '0' ELSE {number('i', 2)} END",
    "link_count_internal": number("i", 9),
    "link_count_external": number("i", 4),
    "readability_fk_grade": f"CASE WHEN i % 4 = 0 THEN '' ELSE {number('i', 18, '.5')} END",
    "extraction_coverage_pct": f"CASE WHEN i % 10 = 0 THEN '' ELSE {number('i * 7', 100, '.5')} END",
    "extraction_coverage_core_pct": f"CASE WHEN i % 12 = 0 THEN '0' ELSE {number('i * 11', 100, '.25')} END",
    "cms_generator": pick("i", "WordPress 6.4", "", "Drupal 10", "Shopify", "WordPress 6.4", ""),
    "author": pick("i", "Ann", "Bo", "", "Cy", " Ann ", "Di", "", "Ed"),
    "publisher": pick("i", "North", "", "South", "East"),
    "json_ld_types": pick("i", "WebPage", "", "Product|Offer", "BlogPosting", "Event", "", "JobPosting", "Recipe| Article"),
    "microdata_types": pick("i", "", "", "Article", "", "Product"),
    "rdfa_types": pick("i", "", "", "", "schema:Thing"),
    "hreflang_links": pick("i", "", "en=https://a|de=https://b", ""),
    "feed_urls": pick("i", "", "", "/feed"),
    "pagination_next": pick("i", "", "", "", "/2"),
    "pagination_prev": pick("i", "", "", "/1", "", ""),
    "breadcrumb_schema": pick("i", "", "Home > Blog"),
    "has_viewport_meta": pick("i", "1", "1", "0"),
    "canonical_url": f"CASE WHEN i % 6 = 0 THEN '' WHEN i % 7 = 0 THEN concat(url, '/') WHEN i % 10 = 1 THEN 'https://canonical.example.com/a' ELSE url END",
    "privacy_policy_url": pick("i", "", "/privacy", ""),
    "analytics_signals": pick("i", "GA4|GTM", "", "Hotjar", "GTM | GA4 |"),
    "training_related_flag": pick("i", "", "", "training"),
    "robots_directives": pick("i", "", "meta:index", "meta:noindex|header:noindex", "", "header:NOINDEX", "noindex", "meta:noindex, follow", "", ""),
    "date_published": f"CASE WHEN i % 6 = 0 THEN '' WHEN i % 15 = 1 THEN 'Tue, 05 Mar 2024 10:00:00 GMT' ELSE {day('i * 5')} END",
    "date_modified": f"CASE WHEN i % 3 = 0 THEN '' WHEN i % 8 = 1 THEN concat({day('i')}, 'T10:20:30+02:00') ELSE {day('i * 7')} END",
    "sitemap_lastmod": f"CASE WHEN i % 5 < 3 THEN '' ELSE {day('i * 3')} END",
    "schema_price": f"CASE WHEN i % 4 = 0 THEN {number('i * 3', 90, '.25')} WHEN i % 14 = 1 THEN 'free' ELSE '' END",
    "schema_availability": pick("i", "InStock", "", "OutOfStock", "", "InStock"),
    "schema_rating": pick("i", "", "4.5", "3.0", ""),
    "schema_review_count": f"CASE WHEN i % 4 < 2 THEN {number('i', 40)} ELSE '' END",
    "schema_event_date": f"CASE WHEN i % 8 = 4 THEN {day('i')} ELSE '' END",
    "schema_event_location": f"CASE WHEN i % 8 = 4 THEN {pick('i', 'Hall', 'Park', '')} ELSE '' END",
    "schema_job_title": f"CASE WHEN i % 8 = 6 THEN {pick('i', 'Nurse', 'Clerk', 'Cook')} ELSE '' END",
    "schema_job_location": f"CASE WHEN i % 8 = 6 THEN {pick('i', 'Leeds', '', 'York')} ELSE '' END",
    "schema_recipe_time": f"CASE WHEN i % 8 = 7 THEN {pick('i', 'PT30M', 'PT1H')} ELSE '' END",
    "referrer_url": f"CASE i % 9 WHEN 0 THEN 'seed' WHEN 1 THEN 'sitemap:https://a/s.xml' WHEN 2 THEN 'https://www.facebook.com/x' WHEN 3 THEN 'https://www.google.com/?q=1' WHEN 4 THEN '' WHEN 5 THEN concat('https://', host, '/') WHEN 6 THEN 'https://www.microsoft.com/' WHEN 7 THEN 'nothing' ELSE 'https://far.example.org/' END",
    "depth": number("i", 5),
    "fetch_time_ms": f"CASE WHEN i % 21 = 0 THEN '' ELSE {number('i * 97', 6000)} END",
    "content_hash": f"CASE WHEN i % 25 = 0 THEN '' ELSE concat('h', CAST(i % 40 AS STRING)) END",
    "tags_all": f"CASE WHEN i % 4 = 0 THEN '' ELSE concat(lower(split_part(title, ' ', 1)), '|topic{{}}|', {pick('i', 'data', 'web', 'x')}) END".replace("topic{}", "topic"),
    "nav_link_count": number("i", 6),
    "wcag_lang_valid": pick("i", "1", "1", "0", "1", ""),
    "wcag_heading_order_valid": pick("i", "1", "0", "1"),
    "wcag_title_present": pick("i", "1", "1", "1", "0"),
    "wcag_form_labels_pct": pick("i", "1.0", "0.5", "", "0.25"),
    "wcag_landmarks_present": pick("i", "1", "0"),
    "wcag_vague_link_pct": pick("i", "0.0", "0.25", "0.03125", ""),
    "wcag_img_alt_pct": pick("i", "1.0", "0.75", "", "1.0", "0.5"),
    "wcag_empty_headings": pick("i", "0", "0", "1"),
    "wcag_duplicate_ids": pick("i", "0", "2", "0", "0"),
    "wcag_empty_buttons": pick("i", "0", "0", "0", "1"),
    "wcag_empty_links": pick("i", "0", "0", "1", "0", "0"),
    "wcag_tables_no_headers": pick("i", "0", "0", "0", "0", "1"),
    "wcag_autocomplete_pct": pick("i", "1.0", "", "0.5"),
    "wcag_has_search": pick("i", "1", "0", "0"),
    "wcag_has_nav": pick("i", "0", "1", "1", "0"),
    "tech_stack_detected": pick("i", "WordPress", "static/unknown", "Drupal"),
    "content_type": pick("i", "text/html", "text/html; charset=utf-8", "", "application/xhtml+xml"),
    "lang": pick("i", "en", "de", "", "fr", "en"),
    "og_title": "CASE WHEN i % 4 = 1 THEN title ELSE '' END",
    "og_description": pick("i", "", "About it"),
    "twitter_card": pick("i", "summary", "", ""),
    "url_content_hint": pick("i", "", "blog_path", "news_path|news_path"),
    "http_last_modified": f"CASE WHEN i % 7 = 1 THEN 'Tue, 05 Mar 2024 10:00:00 GMT' ELSE '' END",
    "etag": f"CASE WHEN i % 3 = 2 THEN {number('i', 99, 'e')} ELSE '' END",
    "referrer_sitemap_url": "CASE WHEN i % 9 = 1 THEN 'https://a/s.xml' ELSE '' END",
    "visible_dates": f"CASE WHEN i % 8 = 3 THEN {day('i')} ELSE '' END",
    "link_count_total": number("i", 12),
    "json_ld_id": pick("i", "", "#a", "", ""),
    "schema_currency": f"CASE WHEN i % 4 = 0 THEN {pick('i', 'GBP', 'EUR')} ELSE '' END",
    "content_changed": pick("i", "1", "0", ""),
    "discovered_at": "concat('2024-0', CAST(1 + r AS STRING), '-01 00:00:0', CAST(i % 10 AS STRING))",
}

_RUN_OF_PAGES = f"SELECT * FROM (SELECT b.*, 0 AS r, '{RUNS[0]}' AS run FROM base b UNION ALL SELECT b.*, 1 AS r, '{RUNS[1]}' AS run FROM base b WHERE i % 4 = 0) x"

#: Number of pages, the ring that links lead along.
_RING = "(SELECT count(*) FROM base)"

TABLES = {
    "base": _BASE,
    "doubled": _RUN_OF_PAGES,
    "pages_raw": "SELECT run, i AS seq, " + ", ".join(f"{v} AS {k}" for k, v in _PAGES.items()) + " FROM doubled",
    # links within the ring, to other sites, and repeated with another text
    "edges": f"""SELECT '{RUNS[0]}' AS run, a.i AS seq, a.url AS from_url, b.url AS to_url, {pick('a.i', 'read more', 'Home', 'here')} AS link_text FROM base a JOIN base b ON b.i = (a.i * 7 + 3) % {_RING}
UNION ALL SELECT '{RUNS[0]}', 100000000 + i, url, concat('https://', {pick('i', 'far.example.org', 'spam-farm.example.org', 'www.facebook.com')}, '/', CAST(i % 5 AS STRING)), 'out' FROM base WHERE i % 3 = 0
UNION ALL SELECT '{RUNS[0]}', 400000000 + i, url, url, 'self' FROM base WHERE i % 2 = 0
UNION ALL SELECT '{RUNS[0]}', 500000000 + a.i, a.url, b.url, 'near' FROM base a JOIN (SELECT host, min(i) AS first FROM base GROUP BY host) f ON f.host = a.host JOIN base b ON b.i = f.first WHERE a.i % 3 <> 1
UNION ALL SELECT '{RUNS[1]}', 200000000 + a.i, upper(a.url), b.url, 'again' FROM base a JOIN base b ON b.i = (a.i * 7 + 3) % {_RING} WHERE a.i % 4 = 0
UNION ALL SELECT '{RUNS[0]}', 300000000 + a.i, a.url, b.url, 'sibling' FROM base a JOIN base b ON b.host = a.host AND b.i = a.i + 58 - a.i % 3""",
    "tags": f"""SELECT run, i AS seq, url AS page_url, {pick('i + r', 'Data', 'web', 'the', 'News', 'data ', 'x')} AS tag_value, {pick('i', 'meta', 'json_ld', 'og')} AS tag_source FROM doubled
UNION ALL SELECT run, 100000000 + i, url, split_part(title, ' ', 1), 'title' FROM doubled
UNION ALL SELECT run, 200000000 + i, url, {pick('i', 'web', 'Health', 'offer')}, 'rel' FROM doubled WHERE i % 2 = 0""",
    "nav_links": f"""SELECT '{RUNS[0]}' AS run, i AS seq, url AS page_url, concat('https://', host, '/', {pick('i', 'about', 'news/2024', 'news/2023', 'shop/a/b')}) AS nav_href, {pick('i', 'About', 'News', 'Old news', 'Shop')} AS nav_text FROM base
UNION ALL SELECT '{RUNS[0]}', 100000000 + i, url, {pick('i', 'https://far.example.org/x', '/relative', 'https://www.facebook.com/p')}, {pick('i', 'Far', 'Near', 'Follow')} FROM base WHERE i % 2 = 0
UNION ALL SELECT '{RUNS[1]}', 200000000 + i, url, concat('https://', host, '/', {pick('i', 'about', 'news/2024', 'news/2023', 'shop/a/b')}), 'Newer' FROM base WHERE i % 4 = 0""",
    "assets": f"""SELECT '{RUNS[0]}' AS run, i AS seq, url AS referrer_page_url, concat('https://', CASE WHEN i % 3 = 0 THEN 'cdn.example.net' ELSE host END, '/f', CAST(i % 30 AS STRING), {pick('i', '.pdf', '.jpg', '.js', '.css', '.PNG', '.docx')}) AS asset_url, {pick('i', 'pdf', 'image', 'script', 'stylesheet', 'image', 'office')} AS category, CASE WHEN i % 6 IN (1, 4) THEN CAST(i * 9973 % 900000 AS STRING) ELSE '' END AS head_content_length FROM base
UNION ALL SELECT '{RUNS[1]}', 100000000 + i, url, concat('https://cdn.example.net/lib', CAST(i % 7 AS STRING), '.js'), 'script', '' FROM base WHERE i % 4 = 0""",
    "errors": f"""SELECT '{RUNS[0]}' AS run, i AS seq, url, {pick('i % 7', 'fetch_failed', 'robots_disallowed', 'non_html', 'fetch_failed', 'content_duplicate')} AS error_type, {pick('i', 'HTTP 404', 'robots', 'type', 'ReadTimeout: timeout', 'dup', 'SSL: certificate', 'HTTP 500')} AS message, {pick('i', '0', '404', '', '500')} AS http_status FROM base WHERE i % 5 = 4 OR i % 11 = 0
UNION ALL SELECT '{RUNS[1]}', 100000000 + i, concat('https://gone.example.org/', CAST(i % 6 AS STRING)), 'fetch_failed', 'HTTP 410', '410' FROM base WHERE i % 10 = 0""",
    "sitemap_urls": f"SELECT '{RUNS[0]}' AS run, i AS seq, url, {day('i * 3')} AS lastmod, concat('https://', host, '/sitemap.xml') AS source_sitemap FROM base WHERE i % 2 = 1",
}

#: What a user's tables are called; base and doubled only serve the others.
NAMES = ("pages_raw", "edges", "tags", "nav_links", "assets", "errors", "sitemap_urls")


def oracle_with(*extra: str) -> str:
    """The WITH clause for DuckDB, and further named statements."""
    return "WITH " + ",\n".join([*(f"{k} AS ({v})" for k, v in TABLES.items()), *extra])


@dataclass
class Estate:
    """The tables of one or more runs."""

    pages_raw: DataFrame
    edges: DataFrame
    tags: DataFrame
    nav_links: DataFrame
    assets: DataFrame
    errors: DataFrame
    sitemap_urls: DataFrame

    def of_runs(self, *runs: str) -> Estate:
        """Only these runs; a table partitioned by run is pruned to them."""
        return Estate(**{n: getattr(self, n).where(getattr(self, n)["run"].isin(*runs)) for n in NAMES})


def load(spark: SparkSession, sf_dir: str) -> Estate:
    ship_package(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    # the ring's length is a joined row: as a subquery it stood within the join's key, and so within what rows are dealt and sorted by.
    # The next page is a column of its own: with all three in one join, a condition on both URLs let Spark pair all pages with all first
    following = "FROM (SELECT /*+ BROADCAST(r) */ base.*, (i * 7 + 3) % ring AS following FROM base CROSS JOIN (SELECT count(*) AS ring FROM base) r) a JOIN base b ON b.i = a.following"
    ring = TABLES | {"edges": TABLES["edges"].replace("FROM base a JOIN base b ON b.i = (a.i * 7 + 3) % " + _RING, following)}
    out = {}
    for name in NAMES:
        needed = [t for t in ("base", "doubled") if t in TABLES[name]]
        if "doubled" in needed:
            needed = ["base", "doubled"]
        clause = ", ".join(f"{t} AS ({TABLES[t].replace('FROM pages', 'FROM {source}') if t == 'base' else TABLES[t]})" for t in needed)
        out[name] = spark.sql(f"WITH {clause} {ring[name]}", source=pages)
    return Estate(**out)
