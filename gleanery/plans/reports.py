"""Dashboard reports over the merged estate, as flat frames: lists of a nested report are rows here. Ranks go by measure,
then by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions import rules, urls
from gleanery.functions.scalars import as_float, as_int, filled, norm_date, parts, rounded, share
from gleanery.operators import frames
from gleanery.operators.frames import capped, counts, exploded, top
from gleanery.plans.registry import Site, host, integer, near, pct, query, real
from gleanery.plans.registry import norm_date as sql_date
from gleanery.plans.registry import parts as sql_parts


def page_url() -> Column:
    """The final URL, else the one requested."""
    return F.coalesce(F.when(F.trim("final_url") != "", F.trim("final_url")), F.trim("requested_url"))


SQL_PAGE = "CASE WHEN trim(final_url) <> '' THEN trim(final_url) ELSE trim(requested_url) END"

#: Signals of a page, by report name: presence of a cell, or a test.
SIGNALS: dict[str, tuple[Callable[[], Column], str]] = {
    "json_ld": (lambda: filled("json_ld_types"), "trim(json_ld_types) <> ''"),
    "microdata": (lambda: filled("microdata_types"), "trim(microdata_types) <> ''"),
    "rdfa": (lambda: filled("rdfa_types"), "trim(rdfa_types) <> ''"),
    "hreflang": (lambda: filled("hreflang_links"), "trim(hreflang_links) <> ''"),
    "feed": (lambda: filled("feed_urls"), "trim(feed_urls) <> ''"),
    "pagination": (lambda: filled("pagination_next") | filled("pagination_prev"), "(trim(pagination_next) <> '' OR trim(pagination_prev) <> '')"),
    "breadcrumb_schema": (lambda: filled("breadcrumb_schema"), "trim(breadcrumb_schema) <> ''"),
    "noindex": (lambda: F.contains(F.lower("robots_directives"), F.lit("noindex")), "contains(lower(robots_directives), 'noindex')"),
}
MORE_SIGNALS: dict[str, tuple[Callable[[], Column], str]] = {
    "canonical": (lambda: filled("canonical_url"), "trim(canonical_url) <> ''"),
    "description": (lambda: filled("meta_description"), "trim(meta_description) <> ''"),
    "title": (lambda: filled("title"), "trim(title) <> ''"),
    "viewport": (lambda: F.col("has_viewport_meta") == "1", "has_viewport_meta = '1'"),
    "author": (lambda: filled("author"), "trim(author) <> ''"),
    "privacy": (lambda: filled("privacy_policy_url"), "trim(privacy_policy_url) <> ''"),
}


def mean_above_zero(c: str, places: int = 1) -> Column:
    x = as_float(c)
    return F.coalesce(rounded(F.avg(F.when(x > 0, x)), places), F.lit(0.0))


def sql_mean_above_zero(c: str, places: int = 1) -> str:
    return f"coalesce({near(f'avg(CASE WHEN {real(c)} > 0 THEN {real(c)} END)', places)}, 0.0)"


def dates(pages: DataFrame, *keep: str) -> DataFrame:
    """A row for each date of a page; sitemap dates count as modification."""
    found = F.array(norm_date("date_published"), norm_date("date_modified"), norm_date("sitemap_lastmod"))
    return pages.select(*keep, F.explode(found).alias("day")).where("day is not null")


SQL_DATES = "dt AS (" + " UNION ALL ".join(f"SELECT domain, cms_generator, content_kind_guess, {sql_date(c)} AS day FROM p" for c in ("date_published", "date_modified", "sitemap_lastmod")) + ")"


@query(
    "domains_summary",
    f"""SELECT domain, count(*) AS page_count, CAST(round_even(CAST(sum({integer('word_count')}) AS DOUBLE) / count(*), 0) AS BIGINT) AS avg_word_count,
{sql_mean_above_zero('readability_fk_grade')} AS avg_readability, CAST(sum({integer('img_count')}) AS BIGINT) AS total_images, CAST(sum({integer('img_missing_alt_count')}) AS BIGINT) AS images_missing_alt,
{pct(f"sum({integer('img_missing_alt_count')})", f"sum({integer('img_count')})")} AS alt_missing_pct, count(*) FILTER (trim(training_related_flag) <> '') AS training_pages,
bool_or(trim(privacy_policy_url) <> '') AS has_privacy_policy, count(*) FILTER (trim(privacy_policy_url) <> '') AS privacy_policy_pages, max({integer('depth')}) AS max_depth,
{near(f"CAST(sum({integer('link_count_internal')}) AS DOUBLE) / count(*)")} AS avg_internal_links, {near(f"CAST(sum({integer('link_count_external')}) AS DOUBLE) / count(*)")} AS avg_external_links,
{pct("count(*) FILTER (wcag_lang_valid = '1')", "count(*)")} AS wcag_lang_pct, {pct("count(*) FILTER (wcag_heading_order_valid = '1')", "count(*)")} AS wcag_heading_order_pct,
{pct("count(*) FILTER (wcag_title_present = '1')", "count(*)")} AS wcag_title_pct, {pct("count(*) FILTER (wcag_landmarks_present = '1')", "count(*)")} AS wcag_landmarks_pct,
{near(f"avg({real('wcag_form_labels_pct')}) * 100")} AS wcag_form_labels_pct, {near(f"avg({real('wcag_vague_link_pct')}) * 100")} AS wcag_vague_link_pct,
{', '.join(f'{pct(f"count(*) FILTER ({s})", "count(*)")} AS {k}_pct' for k, (_, s) in SIGNALS.items())},
{sql_mean_above_zero('extraction_coverage_pct')} AS avg_coverage, {sql_mean_above_zero('extraction_coverage_core_pct')} AS avg_coverage_core FROM p GROUP BY domain""",
)
def domains_summary(s: Site) -> DataFrame:
    n, yes = F.count("*"), lambda c: F.count_if(F.col(c) == "1")
    return s.pages.groupBy("domain").agg(
        n.alias("page_count"),
        F.rint(F.sum(as_int("word_count")) / n).cast("long").alias("avg_word_count"),
        mean_above_zero("readability_fk_grade").alias("avg_readability"),
        F.sum(as_int("img_count")).alias("total_images"),
        F.sum(as_int("img_missing_alt_count")).alias("images_missing_alt"),
        share(F.sum(as_int("img_missing_alt_count")), F.sum(as_int("img_count"))).alias("alt_missing_pct"),
        F.count_if(filled("training_related_flag")).alias("training_pages"),
        F.bool_or(filled("privacy_policy_url")).alias("has_privacy_policy"),
        F.count_if(filled("privacy_policy_url")).alias("privacy_policy_pages"),
        F.max(as_int("depth")).alias("max_depth"),
        rounded(F.sum(as_int("link_count_internal")) / n).alias("avg_internal_links"),
        rounded(F.sum(as_int("link_count_external")) / n).alias("avg_external_links"),
        share(yes("wcag_lang_valid"), n).alias("wcag_lang_pct"),
        share(yes("wcag_heading_order_valid"), n).alias("wcag_heading_order_pct"),
        share(yes("wcag_title_present"), n).alias("wcag_title_pct"),
        share(yes("wcag_landmarks_present"), n).alias("wcag_landmarks_pct"),
        # blank shares count as 0 here
        rounded(F.avg(as_float("wcag_form_labels_pct")) * 100).alias("wcag_form_labels_pct"),
        rounded(F.avg(as_float("wcag_vague_link_pct")) * 100).alias("wcag_vague_link_pct"),
        *(share(F.count_if(c()), n).alias(f"{k}_pct") for k, (c, _) in SIGNALS.items()),
        mean_above_zero("extraction_coverage_pct").alias("avg_coverage"),
        mean_above_zero("extraction_coverage_core_pct").alias("avg_coverage_core"),
    )


@query(
    "domains_errors_assets",
    f"""SELECT d.domain, coalesce(e.n, 0) AS error_count, coalesce(a.n, 0) AS total_assets, coalesce(a.images, 0) AS image_assets FROM (SELECT DISTINCT domain FROM p) d
LEFT JOIN (SELECT {host('url')} AS h, count(*) AS n FROM er GROUP BY 1) e ON e.h = d.domain LEFT JOIN (SELECT {host('referrer_page_url')} AS h, count(*) AS n, count(*) FILTER (category = 'image') AS images FROM ast GROUP BY 1) a ON a.h = d.domain""",
)
def domains_errors_assets(s: Site) -> DataFrame:
    errors = counts(s.errors, urls.host("url").alias("domain"), name="error_count")
    assets = s.assets.groupBy(urls.host("referrer_page_url").alias("domain")).agg(F.count("*").alias("total_assets"), F.count_if(F.col("category") == "image").alias("image_assets"))
    return s.pages.select("domain").distinct().join(errors, "domain", "left").join(assets, "domain", "left").fillna(0)


@query(
    "domains_status_codes",
    f"SELECT domain, status, CAST(sum(n) AS BIGINT) AS n FROM (SELECT domain, http_status AS status, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT {host('url')}, trim(http_status), count(*) FROM er WHERE trim(http_status) NOT IN ('', '0') AND {host('url')} IN (SELECT domain FROM p) GROUP BY ALL) GROUP BY ALL",
)
def domains_status_codes(s: Site) -> DataFrame:
    pages = s.pages.select("domain", F.col("http_status").alias("status"))
    errors = s.errors.select(urls.host("url").alias("domain"), F.trim("http_status").alias("status")).where("status not in ('', '0')")
    return counts(pages.unionByName(errors.join(s.pages.select("domain").distinct(), "domain", "left_semi")), "domain", "status")


@query("domains_content_kinds", "SELECT domain, CASE WHEN trim(content_kind_guess) = '' THEN '(unclassified)' ELSE trim(content_kind_guess) END AS kind, count(*) AS n FROM p GROUP BY ALL")
def domains_content_kinds(s: Site) -> DataFrame:
    kind = F.trim("content_kind_guess")
    return counts(s.pages, "domain", F.when(kind == "", F.lit("(unclassified)")).otherwise(kind).alias("kind"))


@query("domains_analytics", f"SELECT domain, tool, count(*) AS n FROM (SELECT domain, unnest({sql_parts('analytics_signals')}) AS tool FROM p) GROUP BY ALL")
def domains_analytics(s: Site) -> DataFrame:
    return counts(exploded(s.pages, "analytics_signals", "tool", "domain"), "domain", "tool")


@query("domains_top_authors", "SELECT domain, author, n FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, author) AS k FROM (SELECT domain, trim(author) AS author, count(*) AS n FROM p WHERE trim(author) <> '' GROUP BY ALL)) WHERE k <= 5")
def domains_top_authors(s: Site) -> DataFrame:
    return top(counts(s.pages.where(filled("author")), "domain", F.trim("author").alias("author")), 5, "n", "author", per="domain")


@query("domains_primary_cms", "SELECT domain, cms FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, cms) AS k FROM (SELECT domain, trim(cms_generator) AS cms, count(*) AS n FROM p WHERE trim(cms_generator) <> '' GROUP BY ALL)) WHERE k = 1")
def domains_primary_cms(s: Site) -> DataFrame:
    return top(counts(s.pages.where(filled("cms_generator")), "domain", F.trim("cms_generator").alias("cms")), 1, "n", "cms", per="domain").select("domain", "cms")


SQL_LINKS = f"lk AS (SELECT {host('from_url')} AS src, {host('to_url')} AS tgt FROM ed), pd AS (SELECT DISTINCT domain FROM p), gl AS (SELECT src, tgt, count(*) AS weight FROM lk WHERE src <> tgt AND src <> '' AND tgt <> '' AND (src IN (SELECT domain FROM pd) OR tgt IN (SELECT domain FROM pd)) GROUP BY ALL)"


def host_links(s: Site) -> DataFrame:
    """Links between hosts of which one at least has pages."""
    known = s.pages.select(F.col("domain").alias("d")).distinct()
    pairs = counts(s.edges.select(urls.host("from_url").alias("src"), urls.host("to_url").alias("tgt")).where("src <> tgt and src <> '' and tgt <> ''"), "src", "tgt", name="weight")
    return _touching(pairs, known)


def _touching(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Two equality joins instead of one with `or`, which would compare every pair with every domain."""
    a, b = known.select(F.col("d").alias("src"), F.lit(1).alias("_a")), known.select(F.col("d").alias("tgt"), F.lit(1).alias("_b"))
    return pairs.join(a, "src", "left").join(b, "tgt", "left").where("_a is not null or _b is not null").select("src", "tgt", "weight")


@query("domain_graph_links", "SELECT src, tgt, weight FROM gl", SQL_LINKS)
def domain_graph_links(s: Site) -> DataFrame:
    return host_links(s)


@query("domain_graph_nodes", "SELECT d AS domain, row_number() OVER (ORDER BY d) - 1 AS idx, coalesce(n, 0) AS page_count FROM (SELECT domain AS d FROM pd UNION SELECT src FROM gl UNION SELECT tgt FROM gl) LEFT JOIN (SELECT domain AS q, count(*) AS n FROM p GROUP BY 1) ON q = d", SQL_LINKS)
def domain_graph_nodes(s: Site) -> DataFrame:
    links = host_links(s)
    nodes = s.pages.select("domain").union(links.select("src")).union(links.select("tgt")).distinct()
    return frames.ranked(nodes.join(counts(s.pages, "domain", name="page_count"), "domain", "left").select("domain", F.coalesce("page_count", F.lit(0)).alias("page_count")), "domain", "idx")


@query("graph_second_hop", "SELECT DISTINCT a.domain, b.neighbour FROM nb a JOIN nb b ON b.domain = a.neighbour WHERE b.neighbour <> a.domain AND NOT EXISTS (SELECT 1 FROM nb c WHERE c.domain = a.domain AND c.neighbour = b.neighbour) AND a.domain IN (SELECT domain FROM (SELECT domain, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, domain LIMIT 5))", SQL_LINKS, "nb AS (SELECT src AS domain, tgt AS neighbour FROM gl UNION SELECT tgt, src FROM gl)")
def graph_second_hop(s: Site, domains: tuple[str, ...] = ()) -> DataFrame:
    """Neighbours of neighbours of some domains (the five biggest, where none are given) that are no neighbours themselves."""
    near = graph_neighbours(s).select("domain", "neighbour")
    start = s.pages.select("domain").where(F.col("domain").isin(*domains)).distinct() if domains else top(counts(s.pages, "domain"), 5, "n", "domain").select("domain")
    first = near.join(F.broadcast(start), "domain", "left_semi")
    second = first.select("domain", F.col("neighbour").alias("via")).join(near.select(F.col("domain").alias("via"), "neighbour"), "via").select("domain", "neighbour").where("domain <> neighbour").distinct()
    return second.join(first, ["domain", "neighbour"], "left_anti")


@query("chord_matrix", "SELECT a.domain AS src, b.domain AS tgt, count(l.src) FILTER (a.domain <> b.domain) AS n FROM ct a CROSS JOIN ct b LEFT JOIN lk l ON l.src = a.domain AND l.tgt = b.domain GROUP BY ALL", SQL_LINKS, "ct AS (SELECT domain, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, domain LIMIT 30)")
def chord_matrix(s: Site, n: int = 30) -> DataFrame:
    """Links among the n biggest domains; none from a domain to itself."""
    biggest = top(counts(s.pages, "domain"), n, "n", "domain").select("domain")
    # n by n cells, few by definition
    cells = biggest.select(F.col("domain").alias("src"), F.lit(1).alias("_x")).join(biggest.select(F.col("domain").alias("tgt"), F.lit(1).alias("_x")), "_x").drop("_x")
    links = counts(s.edges.select(urls.host("from_url").alias("src"), urls.host("to_url").alias("tgt")).where("src <> tgt"), "src", "tgt")
    return cells.join(links, ["src", "tgt"], "left").fillna(0)


@query("graph_neighbours", "SELECT domain, neighbour, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT src AS domain, tgt AS neighbour, weight FROM gl UNION ALL SELECT tgt, src, weight FROM gl) GROUP BY ALL", SQL_LINKS)
def graph_neighbours(s: Site) -> DataFrame:
    links = host_links(s)
    return links.union(links.select("tgt", "src", "weight")).toDF("domain", "neighbour", "w").groupBy("domain", "neighbour").agg(F.sum("w").alias("weight"))


SQL_TAGS = "tv AS (SELECT page_url, lower(trim(tag_value)) AS tag, tag_source FROM tg WHERE trim(tag_value) <> '' AND length(trim(tag_value)) <= 80), tt AS (SELECT tag, count(*) AS n FROM tv GROUP BY 1 ORDER BY n DESC, tag LIMIT 150)"


def _tags(s: Site) -> DataFrame:
    tag = F.lower(F.trim("tag_value"))
    return s.tags.select("page_url", tag.alias("tag"), "tag_source").where((F.col("tag") != "") & (F.length("tag") <= 80))


@query("tag_frequency", "SELECT tag, n FROM tt", SQL_TAGS)
def tag_frequency(s: Site) -> DataFrame:
    return top(counts(_tags(s), "tag"), 150, "n", "tag")


@query("tag_sources", "SELECT tag_source, count(*) AS n FROM tv GROUP BY 1 ORDER BY n DESC, tag_source LIMIT 20", SQL_TAGS)
def tag_sources(s: Site) -> DataFrame:
    return top(counts(_tags(s), "tag_source"), 20, "n", "tag_source")


@query("tag_cooccurrence", "SELECT a.tag AS a, b.tag AS b, count(*) AS n FROM (SELECT DISTINCT page_url, tag FROM tv WHERE tag IN (SELECT tag FROM tt)) a JOIN (SELECT DISTINCT page_url, tag FROM tv WHERE tag IN (SELECT tag FROM tt)) b ON a.page_url = b.page_url AND a.tag < b.tag GROUP BY ALL ORDER BY n DESC, a, b LIMIT 200", SQL_TAGS)
def tag_cooccurrence(s: Site) -> DataFrame:
    # the 150 tags first, then pairs within a page's set of them: 150 at most
    mine = _tags(s).join(F.broadcast(tag_frequency(s).select("tag")), "tag", "left_semi")
    sets = mine.groupBy("page_url").agg(F.array_sort(F.collect_set("tag")).alias("t"))
    pairs = sets.select("t", F.explode("t").alias("a")).select("a", F.explode("t").alias("b")).where("a < b")
    return top(counts(pairs, "a", "b"), 200, "n", "a", "b")


SQL_NAV = f"nx AS (SELECT DISTINCT {host('page_url')} AS domain, nav_text, nav_href, {host('nav_href')} AS target FROM nv)"


@query("nav_summary", "SELECT domain, count(DISTINCT nav_text) AS labels, count(*) FILTER (target <> domain) AS external FROM nx GROUP BY 1", SQL_NAV)
def nav_summary(s: Site) -> DataFrame:
    links = s.nav.select(urls.host("page_url").alias("domain"), "nav_text", "nav_href", urls.host("nav_href").alias("target")).distinct()
    return links.groupBy("domain").agg(F.count_distinct("nav_text").alias("labels"), F.count_if(F.col("target") != F.col("domain")).alias("external"))


@query(
    "nav_tree_paths",
    f"""SELECT domain, array_to_string(segs[1:d], '/') AS prefix, d AS depth, count(DISTINCT nav_href) AS links, min(CASE WHEN len(segs) = d THEN nav_text END) AS label
FROM (SELECT domain, nav_text, nav_href, list_filter(string_split(regexp_extract(nav_href, '^(?:[a-z]+://[^/?#]*)?([^?#]*)', 1), '/'), lambda x: x <> '') AS segs FROM nx WHERE target IN ('', domain)) x, (SELECT unnest(range(1, 9)) AS d) WHERE d <= len(segs) GROUP BY ALL""",
    SQL_NAV,
)
def nav_tree_paths(s: Site, most: int = 8) -> DataFrame:
    """The tree of internal links, a row for each node: its path so far, how many links lie below, and a leaf's least label."""
    links = s.nav.select(urls.host("page_url").alias("domain"), "nav_text", "nav_href", urls.host("nav_href").alias("target")).distinct().where("target in ('', domain)")
    segments = F.filter(F.split(urls.path("nav_href"), "/"), lambda x: x != "")
    nodes = links.withColumn("segs", segments).withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(most)))).where(F.col("d") <= F.size("segs"))
    return nodes.groupBy("domain", F.array_join(F.slice("segs", F.lit(1), F.col("d")), "/").alias("prefix"), F.col("d").cast("long").alias("depth")).agg(F.count_distinct("nav_href").alias("links"), F.min(F.when(F.size("segs") == F.col("d"), F.col("nav_text"))).alias("label"))


_SQL_LABELS_NAV = f"nl AS (SELECT {host('page_url')} AS domain, trim(nav_text) AS name, min(trim(nav_href)) AS href, count(DISTINCT trim(nav_href)) AS size FROM nv WHERE {host('page_url')} <> '' AND trim(nav_text) <> '' GROUP BY ALL)"
_SQL_NAV_TREE = f"""ni AS (SELECT *, list_filter(string_split(regexp_extract(href, '^(?:[a-z]+://[^/?#]*)?([^?#]*)', 1), '/'), lambda x: x <> '') AS segs FROM nl WHERE {host('href')} IN ('', domain)),
np AS (SELECT domain, name, href, segs, k, array_to_string(segs[1:k], '/') AS prefix, CASE WHEN k = 2 OR len(segs) = k THEN concat('n:', name) ELSE concat('s:', segs[k + 1]) END AS child FROM ni, (SELECT unnest([1, 2]) AS k) WHERE k <= len(segs)),
ng AS (SELECT domain, prefix FROM np GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT child) > 1)"""


@query(
    "nav_tree",
    f"""SELECT domain, 'internal' AS branch, coalesce(parents, '') AS parents, name, href, CAST(1 AS BIGINT) AS size FROM (SELECT ni.*, (SELECT string_agg(concat('/', np.segs[np.k]), '>' ORDER BY np.k) FROM np JOIN ng ON ng.domain = np.domain AND ng.prefix = np.prefix WHERE np.domain = ni.domain AND np.name = ni.name) AS parents FROM ni)
UNION ALL SELECT domain, 'external', CASE WHEN count(*) OVER (PARTITION BY domain, {host('href')}) > 1 THEN {host('href')} ELSE '' END, name, href, size FROM nl WHERE {host('href')} NOT IN ('', domain)""",
    _SQL_LABELS_NAV,
    _SQL_NAV_TREE,
)
def nav_tree(s: Site, depth: int = 2) -> DataFrame:
    """The tree of each domain's labels, a row for each leaf with the groups above it. A group is a path prefix, of `depth` segments
    at most, that parts into two things at least; one that doesn't gives way to what it holds. External labels are grouped by their
    host. A label with several links takes the least of them."""
    labels = s.nav.groupBy(urls.host("page_url").alias("domain"), F.trim("nav_text").alias("name")).agg(F.min(F.trim("nav_href")).alias("href"), F.count_distinct(F.trim("nav_href")).alias("size")).where("domain <> '' and name <> ''")
    labels = labels.withColumn("target", urls.host("href"))
    items = labels.where("target in ('', domain)").withColumn("segs", F.filter(F.split(urls.path("href"), "/"), lambda x: x != ""))
    here = F.slice("segs", F.lit(1), F.col("k"))
    below = F.when((F.col("k") == depth) | (F.size("segs") == F.col("k")), F.concat(F.lit("n:"), "name")).otherwise(F.concat(F.lit("s:"), F.get("segs", F.col("k"))))
    prefixes = items.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(depth)))).where(F.col("k") <= F.size("segs")).withColumn("prefix", F.array_join(here, "/"))
    groups = prefixes.groupBy("domain", "prefix").agg(F.count("*").alias("n"), F.count_distinct(below).alias("m")).where("n > 1 and m > 1").select("domain", "prefix")
    # at most `depth` groups lie above a leaf
    above = prefixes.join(groups, ["domain", "prefix"], "left_semi").groupBy("domain", "name").agg(F.array_sort(F.collect_list(F.struct("k", F.concat(F.lit("/"), F.element_at("segs", F.col("k"))).alias("g")))).alias("x"))
    parents = F.coalesce(F.array_join(F.transform("x", lambda p: p["g"]), ">"), F.lit(""))
    inner = items.join(above, ["domain", "name"], "left").select("domain", F.lit("internal").alias("branch"), parents.alias("parents"), "name", "href", F.lit(1).cast("long").alias("size"))
    # how many labels a target has is an aggregate, combined before the shuffle: no target's labels lie in one task
    outside = labels.where("target not in ('', domain)")
    sizes = outside.groupBy(F.col("domain").alias("d"), F.col("target").alias("t")).agg(F.count("*").alias("n"))
    outer = outside.join(sizes.hint("shuffle_merge"), (F.col("domain") == F.col("d")) & (F.col("target") == F.col("t")))
    return inner.union(outer.select("domain", F.lit("external"), F.when(F.col("n") > 1, F.col("target")).otherwise(F.lit("")), "name", "href", "size"))


@query("freshness", "SELECT domain, min(day) AS oldest, max(day) AS latest, count(*) AS n FROM dt WHERE day IS NOT NULL GROUP BY 1", SQL_DATES)
def freshness(s: Site) -> DataFrame:
    return dates(s.pages, "domain").groupBy("domain").agg(F.min("day").alias("oldest"), F.max("day").alias("latest"), F.count("*").alias("n"))


@query("freshness_buckets", "SELECT domain, substr(day, 1, 7) AS month, count(*) AS n FROM dt WHERE day IS NOT NULL GROUP BY ALL", SQL_DATES)
def freshness_buckets(s: Site) -> DataFrame:
    return counts(dates(s.pages, "domain"), "domain", F.substring("day", 1, 7).alias("month"))


_SQL_PRIMARY = "pc AS (SELECT domain AS d, cms FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, cms) AS k FROM (SELECT domain, trim(cms_generator) AS cms, count(*) AS n FROM p WHERE trim(cms_generator) <> '' GROUP BY ALL)) WHERE k = 1), pk AS (SELECT domain AS d, kind FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, kind) AS k FROM (SELECT domain, CASE WHEN trim(content_kind_guess) = '' THEN '(unclassified)' ELSE trim(content_kind_guess) END AS kind, count(*) AS n FROM p GROUP BY ALL)) WHERE k = 1)"


def domain_groups(s: Site, by: str) -> DataFrame:
    """domain and grp: its commonest system or kind of page, or its owner."""
    if by == "ownership":
        return s.pages.select("domain").distinct().withColumn("grp", rules.ownership("domain"))
    if by == "kind":
        return top(domains_content_kinds(s), 1, "n", "kind", per="domain").select("domain", F.col("kind").alias("grp"))
    known = s.pages.select("domain").distinct().join(domains_primary_cms(s), "domain", "left")
    return known.select("domain", F.coalesce("cms", F.lit("(undetected)")).alias("grp"))


def freshness_by(s: Site, by: str) -> DataFrame:
    groups = freshness(s).join(domain_groups(s, by), "domain").groupBy("grp").agg(F.min("oldest").alias("oldest"), F.max("latest").alias("latest"))
    return groups.orderBy(F.desc("latest"), "grp").limit(50)


_SQL_FRESH = "SELECT grp, min(day) AS oldest, max(day) AS latest FROM (SELECT day, {x} AS grp FROM dt {j}) WHERE day IS NOT NULL GROUP BY 1 ORDER BY latest DESC, grp LIMIT 50"


@query("freshness_groups", _SQL_FRESH.format(x="coalesce(cms, '(undetected)')", j="LEFT JOIN pc ON pc.d = dt.domain"), SQL_DATES, _SQL_PRIMARY)
def freshness_groups(s: Site) -> DataFrame:
    return freshness_by(s, "cms")


@query("freshness_kinds", _SQL_FRESH.format(x="kind", j="JOIN pk ON pk.d = dt.domain"), SQL_DATES, _SQL_PRIMARY)
def freshness_kinds(s: Site) -> DataFrame:
    return freshness_by(s, "kind")


@query("cms_distribution", "SELECT trim(cms_generator) AS cms, count(*) AS pages, count(DISTINCT domain) AS domains FROM p WHERE trim(cms_generator) <> '' GROUP BY 1")
def cms_distribution(s: Site) -> DataFrame:
    return s.pages.where(filled("cms_generator")).groupBy(F.trim("cms_generator").alias("cms")).agg(F.count("*").alias("pages"), F.count_distinct("domain").alias("domains"))


@query("cms_top_domains", "SELECT cms, domain, n FROM (SELECT *, row_number() OVER (PARTITION BY cms ORDER BY n DESC, domain) AS k FROM (SELECT trim(cms_generator) AS cms, domain, count(*) AS n FROM p WHERE trim(cms_generator) <> '' GROUP BY ALL)) WHERE k <= 20")
def cms_top_domains(s: Site) -> DataFrame:
    return top(counts(s.pages.where(filled("cms_generator")), F.trim("cms_generator").alias("cms"), "domain"), 20, "n", "domain", per="cms")


@query("schema_adoption", " UNION ALL ".join(f"SELECT '{k}' AS signal, count(*) FILTER ({c}) AS pages, count(*) AS total FROM p" for k, (_, c) in SIGNALS.items()))
def schema_adoption(s: Site) -> DataFrame:
    wide = s.pages.agg(F.count("*").alias("total"), *(F.count_if(c()).alias(k) for k, (c, _) in SIGNALS.items()))
    return wide.unpivot(["total"], list(SIGNALS), "signal", "pages").select("signal", "pages", "total")


@query("schema_type_freq", f"SELECT t AS type, count(*) AS n FROM (SELECT unnest({sql_parts('json_ld_types')}) AS t FROM p UNION ALL SELECT unnest({sql_parts('microdata_types')}) FROM p) GROUP BY 1 ORDER BY n DESC, type LIMIT 40")
def schema_type_freq(s: Site) -> DataFrame:
    types = s.pages.select(F.explode(F.concat(parts("json_ld_types"), parts("microdata_types"))).alias("type"))
    return top(counts(types, "type"), 40, "n", "type")


READY = ("canonical", "description", "title", "viewport", "hreflang", "feed", "json_ld")
ALL_SIGNALS = SIGNALS | MORE_SIGNALS


@query("seo_readiness", f"SELECT domain, count(*) AS pages, {', '.join(f'count(*) FILTER ({ALL_SIGNALS[k][1]}) AS {k}' for k in READY)} FROM p GROUP BY 1")
def seo_readiness(s: Site) -> DataFrame:
    return s.pages.groupBy("domain").agg(F.count("*").alias("pages"), *(F.count_if(ALL_SIGNALS[k][0]()).alias(k) for k in READY))


@query("coverage_histogram", f"SELECT b AS bucket, count(x) AS n FROM (SELECT unnest(range(0, 100, 10)) AS b) LEFT JOIN (SELECT CAST(least(floor({real('extraction_coverage_pct')} / 10) * 10, 90) AS BIGINT) AS x FROM p) ON x = b GROUP BY 1")
def coverage_histogram(s: Site) -> DataFrame:
    bucket = F.least(F.floor(as_float("extraction_coverage_pct") / 10) * 10, F.lit(90)).cast("long")
    return s.pages.sparkSession.range(0, 100, 10).toDF("bucket").join(counts(s.pages, bucket.alias("bucket")), "bucket", "left").fillna(0)


def _by_name(s: Site, column: str, n: int) -> DataFrame:
    return top(s.pages.where(filled(column)).groupBy(F.trim(column).alias(column)).agg(F.count("*").alias("pages"), F.count_distinct("domain").alias("domains")), n, "pages", column)


def _sql_by_name(column: str, n: int) -> str:
    return f"SELECT trim({column}) AS {column}, count(*) AS pages, count(DISTINCT domain) AS domains FROM p WHERE trim({column}) <> '' GROUP BY 1 ORDER BY pages DESC, 1 LIMIT {n}"


@query("authors_top", _sql_by_name("author", 50))
def authors_top(s: Site) -> DataFrame:
    return _by_name(s, "author", 50)


@query("publishers_top", _sql_by_name("publisher", 30))
def publishers_top(s: Site) -> DataFrame:
    return _by_name(s, "publisher", 30)


@query("author_network", f"SELECT author, domain, n FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY n DESC, domain) AS k FROM (SELECT trim(author) AS author, domain, count(*) AS n FROM p WHERE trim(author) IN (SELECT author FROM ({_sql_by_name('author', 30)})) GROUP BY ALL)) WHERE k <= 10")
def author_network(s: Site) -> DataFrame:
    pairs = counts(s.pages.where(filled("author")), F.trim("author").alias("author"), "domain")
    return top(pairs.join(F.broadcast(_by_name(s, "author", 30).select("author")), "author", "left_semi"), 10, "n", "domain", per="author")


def _domains_of(s: Site, column: str, names: int, most: int = 10) -> DataFrame:
    pairs = counts(s.pages.where(filled(column)), F.trim(column).alias(column), "domain")
    return top(pairs.join(F.broadcast(_by_name(s, column, names).select(column)), column, "left_semi"), most, "n", "domain", per=column)


def _sql_domains_of(column: str, names: int) -> str:
    return f"SELECT {column}, domain, n FROM (SELECT *, row_number() OVER (PARTITION BY {column} ORDER BY n DESC, domain) AS k FROM (SELECT trim({column}) AS {column}, domain, count(*) AS n FROM p WHERE trim({column}) IN (SELECT {column} FROM ({_sql_by_name(column, names)})) GROUP BY ALL)) WHERE k <= 10"


@query("author_domains", _sql_domains_of("author", 50))
def author_domains(s: Site) -> DataFrame:
    return _domains_of(s, "author", 50)


@query("publisher_domains", _sql_domains_of("publisher", 30))
def publisher_domains(s: Site) -> DataFrame:
    return _domains_of(s, "publisher", 30)


@query("domains_top_publishers", "SELECT domain, publisher, n FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, publisher) AS k FROM (SELECT domain, trim(publisher) AS publisher, count(*) AS n FROM p WHERE trim(publisher) <> '' GROUP BY ALL)) WHERE k <= 3")
def domains_top_publishers(s: Site) -> DataFrame:
    return top(counts(s.pages.where(filled("publisher")), "domain", F.trim("publisher").alias("publisher")), 3, "n", "publisher", per="domain")


@query("domains_schema_types", f"SELECT domain, type, n FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, type) AS k FROM (SELECT domain, t AS type, count(*) AS n FROM (SELECT domain, unnest({sql_parts('json_ld_types')}) AS t FROM p UNION ALL SELECT domain, unnest({sql_parts('microdata_types')}) FROM p) GROUP BY ALL)) WHERE k <= 20")
def domains_schema_types(s: Site) -> DataFrame:
    types = s.pages.select("domain", F.explode(F.concat(parts("json_ld_types"), parts("microdata_types"))).alias("type"))
    return top(counts(types, "domain", "type"), 20, "n", "type", per="domain")


@query("domains_titles", "SELECT domain, title FROM (SELECT domain, trim(title) AS title, row_number() OVER (PARTITION BY domain ORDER BY run, seq) AS k FROM p WHERE trim(title) <> '') WHERE k <= 3")
def domains_titles(s: Site) -> DataFrame:
    """The first titles of each domain."""
    first = F.row_number().over(Window.partitionBy("domain").orderBy("run", "seq"))
    return s.pages.where(filled("title")).select("domain", F.trim("title").alias("title"), first.alias("k")).where("k <= 3").drop("k")


@query("domains_assets", f"SELECT {host('referrer_page_url')} AS domain, CASE WHEN trim(category) = '' THEN 'other' ELSE trim(category) END AS category, count(*) AS n FROM ast WHERE {host('referrer_page_url')} <> '' GROUP BY ALL")
def domains_assets(s: Site) -> DataFrame:
    return counts(s.assets, urls.host("referrer_page_url").alias("domain"), F.when(filled("category"), F.trim("category")).otherwise(F.lit("other")).alias("category")).where("domain <> ''")


@query("domains_ownership", "SELECT DISTINCT domain, array_to_string(string_split(lower(domain), '.')[-2:], '.') AS owner FROM p")
def domains_ownership(s: Site) -> DataFrame:
    return s.pages.select("domain").distinct().select("domain", rules.ownership("domain").alias("owner"))


#: Items of a kind, by what marks them; a summary needs three.
ITEMS = {"products": ("schema_price", "product"), "events": ("schema_event_date", "event"), "jobs": ("schema_job_title", "job"), "recipes": ("schema_recipe_time", "recipe")}
_SQL_PRICE = f"CASE WHEN {real('schema_price')} > 0 THEN {real('schema_price')} END"


@query("products_summary", f"SELECT count(*) AS n, min({_SQL_PRICE}) AS min_price, max({_SQL_PRICE}) AS max_price, {near(f'avg({_SQL_PRICE})', 2)} AS avg_price FROM p WHERE trim(schema_price) <> '' HAVING count(*) >= 3")
def products_summary(s: Site) -> DataFrame:
    price = F.when(as_float("schema_price") > 0, as_float("schema_price"))
    return s.pages.where(filled("schema_price")).agg(F.count("*").alias("n"), F.min(price).alias("min_price"), F.max(price).alias("max_price"), rounded(F.avg(price), 2).alias("avg_price")).where("n >= 3")


def _items(s: Site, mark: str, name: str, column: str, n: int) -> DataFrame:
    """Counts of a column's values among items, none below three items."""
    items = s.pages.where(filled(mark))
    enough = items.agg((F.count("*") >= 3).alias("_enough"))
    return top(counts(items.where(filled(column)), F.trim(column).alias(name)).join(F.broadcast(enough)).where("_enough").drop("_enough"), n, "n", name)


def _sql_items(mark: str, name: str, column: str, n: int) -> str:
    return f"SELECT trim({column}) AS {name}, count(*) AS n FROM p WHERE trim({mark}) <> '' AND trim({column}) <> '' AND (SELECT count(*) FROM p WHERE trim({mark}) <> '') >= 3 GROUP BY 1 ORDER BY n DESC, 1 LIMIT {n}"


@query("product_availability", _sql_items("schema_price", "availability", "schema_availability", 10))
def product_availability(s: Site) -> DataFrame:
    return _items(s, "schema_price", "availability", "schema_availability", 10)


@query("events_summary", _sql_items("schema_event_date", "location", "schema_event_location", 50))
def events_summary(s: Site) -> DataFrame:
    return _items(s, "schema_event_date", "location", "schema_event_location", 50)


@query("jobs_summary", _sql_items("schema_job_title", "title", "schema_job_title", 50))
def jobs_summary(s: Site) -> DataFrame:
    return _items(s, "schema_job_title", "title", "schema_job_title", 50)


@query("recipes_summary", _sql_items("schema_recipe_time", "time", "schema_recipe_time", 50))
def recipes_summary(s: Site) -> DataFrame:
    return _items(s, "schema_recipe_time", "time", "schema_recipe_time", 50)


_SQL_ENOUGH = "(SELECT count(*) FROM p WHERE trim({m}) <> '') >= 3"


@query("items_by_domain", " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS kind, domain, count(*) AS n FROM p WHERE trim({m}) <> '' AND {_SQL_ENOUGH.format(m=m)} GROUP BY 2 ORDER BY n DESC, domain LIMIT 20)" for k, (m, _) in ITEMS.items()))
def items_by_domain(s: Site) -> DataFrame:
    """Products, events, jobs and recipes of each domain, the first 20 of a kind; none of a kind with fewer than three."""
    kinds = F.array_compact(F.array(*(F.when(filled(m), F.lit(k)) for k, (m, _) in ITEMS.items())))
    rows = counts(s.pages.select("domain", F.explode(kinds).alias("kind")), "kind", "domain")
    enough = rows.groupBy("kind").agg(F.sum("n").alias("_t")).where("_t >= 3").select("kind")
    return top(rows.join(F.broadcast(enough), "kind", "left_semi"), 20, "n", "domain", per="kind")


def _listed(s: Site, mark: str, order: tuple, cap: int, **columns: Column) -> DataFrame:
    """Items, the first in their order, ties by all columns; none of a kind with fewer than three."""
    items = s.pages.where(filled(mark))
    enough = items.limit(3).agg((F.count("*") >= 3).alias("_enough"))  # one row, within the plan
    return items.join(F.broadcast(enough)).where("_enough").select(F.col("final_url").alias("url"), "domain", *(c.alias(n) for n, c in columns.items())).orderBy(*dict.fromkeys((*order, "url", "domain", *columns))).limit(cap)


@query("top_rated_products", f"SELECT final_url AS url, domain, substr(title, 1, 80) AS title, {real('schema_rating')} AS rating, {integer('schema_review_count')} AS reviews FROM p WHERE trim(schema_price) <> '' AND {real('schema_rating')} > 0 AND {_SQL_ENOUGH.format(m='schema_price')} ORDER BY rating DESC, url LIMIT 10")
def top_rated_products(s: Site) -> DataFrame:
    rows = _listed(s, "schema_price", ("url",), 1 << 30, title=F.substring("title", 1, 80), rating=as_float("schema_rating"), reviews=as_int("schema_review_count"))
    return rows.where("rating > 0").orderBy(F.desc("rating"), "url", "domain", "title", "reviews").limit(10)


@query("events_by_date", f"SELECT final_url AS url, domain, trim(schema_event_date) AS day, schema_event_location AS location FROM p WHERE trim(schema_event_date) <> '' AND {_SQL_ENOUGH.format(m='schema_event_date')} ORDER BY day, url LIMIT 50")
def events_by_date(s: Site) -> DataFrame:
    return _listed(s, "schema_event_date", ("day", "url"), 50, day=F.trim("schema_event_date"), location=F.col("schema_event_location"))


@query("jobs_listed", f"SELECT final_url AS url, domain, trim(schema_job_title) AS job, schema_job_location AS location FROM p WHERE trim(schema_job_title) <> '' AND {_SQL_ENOUGH.format(m='schema_job_title')} ORDER BY url, job LIMIT 50")
def jobs_listed(s: Site) -> DataFrame:
    return _listed(s, "schema_job_title", ("url", "job"), 50, job=F.trim("schema_job_title"), location=F.col("schema_job_location"))


@query("jobs_by_location", _sql_items("schema_job_title", "location", "schema_job_location", 20))
def jobs_by_location(s: Site) -> DataFrame:
    return _items(s, "schema_job_title", "location", "schema_job_location", 20)


@query("recipes_listed", f"SELECT final_url AS url, domain, trim(schema_recipe_time) AS time FROM p WHERE trim(schema_recipe_time) <> '' AND {_SQL_ENOUGH.format(m='schema_recipe_time')} ORDER BY url, time LIMIT 50")
def recipes_listed(s: Site) -> DataFrame:
    return _listed(s, "schema_recipe_time", ("url", "time"), 50, time=F.trim("schema_recipe_time"))


SQL_DEPTH = f"dp AS (SELECT *, {integer('depth')} AS dep FROM p)"


@query("depth_histogram", "SELECT CAST(d AS BIGINT) AS depth, count(dep) AS n FROM (SELECT unnest(range(0, (SELECT max(dep) + 1 FROM dp))) AS d) LEFT JOIN dp ON dep = d GROUP BY 1", SQL_DEPTH)
def depth_histogram(s: Site) -> DataFrame:
    deepest = s.pages.agg(F.max(as_int("depth")).alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("depth"))
    return deepest.join(counts(s.pages, as_int("depth").alias("depth")), "depth", "left").fillna(0)


@query("depth_quality", f"SELECT dep AS depth, {near(f'avg({integer("word_count")})')} AS words, {sql_mean_above_zero('extraction_coverage_pct')} AS coverage, {sql_mean_above_zero('readability_fk_grade')} AS readability FROM dp GROUP BY 1", SQL_DEPTH)
def depth_quality(s: Site) -> DataFrame:
    return s.pages.groupBy(as_int("depth").alias("depth")).agg(rounded(F.avg(as_int("word_count"))).alias("words"), mean_above_zero("extraction_coverage_pct").alias("coverage"), mean_above_zero("readability_fk_grade").alias("readability"))


@query("domain_depth", "SELECT domain, dep AS depth, count(*) AS n FROM dp WHERE domain IN (SELECT domain FROM (SELECT domain, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, domain LIMIT 30)) GROUP BY ALL", SQL_DEPTH)
def domain_depth(s: Site) -> DataFrame:
    biggest = top(counts(s.pages, "domain"), 30, "n", "domain").select("domain")
    return counts(s.pages.join(F.broadcast(biggest), "domain", "left_semi"), "domain", as_int("depth").alias("depth"))


@query("depth_kpis", f"SELECT count(*) AS pages, max(dep) AS deepest, {near('avg(dep)', 2)} AS mean_depth, (SELECT dep FROM (SELECT dep, count(*) AS n FROM dp GROUP BY 1 ORDER BY n DESC, dep LIMIT 1)) AS modal_depth FROM dp", SQL_DEPTH)
def depth_kpis(s: Site) -> DataFrame:
    by_depth = counts(s.pages, as_int("depth").alias("d"))
    return by_depth.agg(F.sum("n").alias("pages"), F.max("d").alias("deepest"), rounded(F.sum(F.col("n") * F.col("d")) / F.sum("n"), 2).alias("mean_depth"), F.max_by(F.col("d"), F.struct("n", -F.col("d"))).alias("modal_depth"))


_SQL_BIGGEST = "big AS (SELECT domain, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, domain LIMIT 40)"
_SQL_HEALTH = "hl AS (" + " UNION ALL ".join(f"SELECT domain, '{k}' AS signal, {pct(f'count(*) FILTER ({c})', 'count(*)')} AS pct FROM p WHERE domain IN (SELECT domain FROM big) GROUP BY 1" for k, (_, c) in ALL_SIGNALS.items()) + ")"


@query("content_health", "SELECT * FROM hl", _SQL_BIGGEST, _SQL_HEALTH)
def content_health(s: Site) -> DataFrame:
    biggest = top(counts(s.pages, "domain"), 40, "n", "domain").select("domain")
    wide = s.pages.join(F.broadcast(biggest), "domain", "left_semi").groupBy("domain").agg(*(share(F.count_if(c()), F.count("*")).alias(k) for k, (c, _) in ALL_SIGNALS.items()))
    return wide.unpivot(["domain"], list(ALL_SIGNALS), "signal", "pct")


@query("health_scores", f"SELECT domain, {near('CAST(sum(CAST(round_even(pct * 10, 0) AS BIGINT)) AS DOUBLE) / 10 / count(*)')} AS score FROM hl GROUP BY 1", _SQL_BIGGEST, _SQL_HEALTH)
def health_scores(s: Site) -> DataFrame:
    # tenths are summed as integers, so that the order of rows leaves no trace
    return content_health(s).groupBy("domain").agg(rounded(F.sum(F.rint(F.col("pct") * 10).cast("long")) / 10 / F.count("*")).alias("score"))


_SQL_WHOLE = "hs AS (SELECT domain, floor(CAST(sum(CAST(round_even(pct * 10, 0) AS BIGINT)) AS DOUBLE) / 10 / count(*) + 0.5) AS score FROM hl GROUP BY 1)"


@query("health_signals", "SELECT signal, CAST(floor(CAST(sum(CAST(round_even(pct * 10, 0) AS BIGINT)) AS DOUBLE) / 10 / count(*) + 0.5) AS BIGINT) AS mean, CAST(sum(CAST(round_even(pct * 10, 0) AS BIGINT)) AS DOUBLE) / 10 / count(*) + 0.5 < 50 AS weak FROM hl GROUP BY 1", _SQL_BIGGEST, _SQL_HEALTH)
def health_signals(s: Site) -> DataFrame:
    """Each signal's mean over the domains, halves upwards, and whether it is below half."""
    mean = F.sum(F.rint(F.col("pct") * 10).cast("long")) / 10 / F.count("*") + 0.5
    return content_health(s).groupBy("signal").agg(F.floor(mean).cast("long").alias("mean"), (mean < 50).alias("weak"))


@query("health_overall", "SELECT count(*) AS domains, CAST(floor(avg(score) + 0.5) AS BIGINT) AS overall FROM hs", _SQL_BIGGEST, _SQL_HEALTH, _SQL_WHOLE)
def health_overall(s: Site) -> DataFrame:
    scores = content_health(s).groupBy("domain").agg(F.floor(F.sum(F.rint(F.col("pct") * 10).cast("long")) / 10 / F.count("*") + 0.5).alias("score"))
    return scores.agg(F.count("*").alias("domains"), F.floor(F.avg("score") + 0.5).cast("long").alias("overall"))


# Competitor intelligence


@query("ci_top_tags", f"SELECT tag, count(*) AS n FROM (SELECT lower(trim(tag_value)) AS tag FROM tg) WHERE length(tag) BETWEEN 3 AND 80 AND tag NOT IN ('the', 'and', 'for', 'with', 'from', 'this', 'that', 'your', 'our', 'are', 'was', 'has', 'have', 'been', 'will', 'can', 'all', 'not', 'but', 'you', 'more', 'page', 'home', 'site', 'www', 'com') GROUP BY 1 ORDER BY n DESC, tag LIMIT 50")
def ci_top_tags(s: Site) -> DataFrame:
    tags = s.tags.select(F.lower(F.trim("tag_value")).alias("tag")).where(F.length("tag").between(3, 80) & ~F.col("tag").isin(*rules.STOP_WORDS))
    return top(counts(tags, "tag"), 50, "n", "tag")


@query("ci_top_pages", f"SELECT {SQL_PAGE} AS url, {integer('word_count')} AS words, {real('extraction_coverage_pct')} AS coverage FROM p ORDER BY words DESC, coverage DESC, url LIMIT 40")
def ci_top_pages(s: Site) -> DataFrame:
    return s.pages.select(page_url().alias("url"), as_int("word_count").alias("words"), as_float("extraction_coverage_pct").alias("coverage")).orderBy(F.desc("words"), F.desc("coverage"), "url").limit(40)


@query("ci_price_by_domain", f"SELECT domain, count(*) AS n, min(x) AS min_price, max(x) AS max_price, {near('avg(x)', 2)} AS avg_price FROM (SELECT domain, {_SQL_PRICE} AS x FROM p) WHERE x IS NOT NULL GROUP BY 1 ORDER BY n DESC, domain LIMIT 25")
def ci_price_by_domain(s: Site) -> DataFrame:
    prices = s.pages.select("domain", as_float("schema_price").alias("x")).where("x > 0")
    return top(prices.groupBy("domain").agg(F.count("*").alias("n"), F.min("x").alias("min_price"), F.max("x").alias("max_price"), rounded(F.avg("x"), 2).alias("avg_price")), 25, "n", "domain")


# Words of promotions.
_PROMO = r"(?i)\b(sale|offer|clearance|promo|discount|deal|save)\b"


@query("ci_promos", f"SELECT {SQL_PAGE} AS url, title FROM p WHERE trim(schema_price) <> '' AND regexp_matches(lower(concat(substr(title, 1, 120), ' ', trim(schema_availability))), '(^|[^a-z0-9_])(sale|offer|clearance|promo|discount|deal|save)($|[^a-z0-9_])') ORDER BY url, title LIMIT 30")
def ci_promos(s: Site, cap: int | None = 30) -> DataFrame:
    """Priced pages whose title or availability speaks of a promotion."""
    said = F.concat_ws(" ", F.substring("title", 1, 120), F.trim("schema_availability"))
    out = s.pages.where(filled("schema_price") & said.rlike(_PROMO)).select(page_url().alias("url"), "title").orderBy("url", "title")
    return out.limit(cap) if cap else out


@query("ci_products", f"SELECT {SQL_PAGE} AS url, domain, {real('schema_price')} AS price, {integer('schema_review_count')} AS reviews, {real('schema_rating')} AS rating, trim(schema_availability) AS availability FROM p WHERE trim(schema_price) <> '' ORDER BY reviews DESC, price DESC, url LIMIT 60")
def ci_products(s: Site, cap: int | None = 60) -> DataFrame:
    """Products by reviews, then by price."""
    rows = s.pages.where(filled("schema_price")).select(page_url().alias("url"), "domain", as_float("schema_price").alias("price"), as_int("schema_review_count").alias("reviews"), as_float("schema_rating").alias("rating"), F.trim("schema_availability").alias("availability"))
    out = rows.orderBy(F.desc("reviews"), F.desc("price"), "url")
    return out.limit(cap) if cap else out


@query("ci_availability", "SELECT trim(schema_availability) AS availability, count(*) AS n FROM p WHERE trim(schema_price) <> '' AND trim(schema_availability) <> '' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15")
def ci_availability(s: Site) -> DataFrame:
    return top(counts(s.pages.where(filled("schema_price") & filled("schema_availability")), F.trim("schema_availability").alias("availability")), 15, "n", "availability")


@query("ci_pairs", "SELECT src, tgt, count(*) AS n FROM lk WHERE src <> tgt AND src <> '' AND tgt <> '' GROUP BY ALL ORDER BY n DESC, src, tgt LIMIT 40", SQL_LINKS)
def ci_pairs(s: Site) -> DataFrame:
    pairs = s.edges.select(urls.host("from_url").alias("src"), urls.host("to_url").alias("tgt")).where("src <> tgt and src <> '' and tgt <> ''")
    return top(counts(pairs, "src", "tgt"), 40, "n", "src", "tgt")


@query("ci_inbound", "SELECT tgt AS domain, count(*) AS n FROM lk WHERE src <> tgt AND src <> '' AND tgt IN (SELECT domain FROM pd) GROUP BY 1 ORDER BY n DESC, domain LIMIT 30", SQL_LINKS)
def ci_inbound(s: Site) -> DataFrame:
    links = s.edges.select(urls.host("from_url").alias("src"), urls.host("to_url").alias("domain")).where("src <> domain and src <> ''")
    return top(counts(links.join(s.pages.select("domain").distinct(), "domain", "left_semi"), "domain"), 30, "n", "domain")


@query("ci_outbound", "SELECT src AS domain, count(*) AS n FROM lk WHERE src IN (SELECT domain FROM pd) AND tgt <> '' AND tgt NOT IN (SELECT domain FROM pd) GROUP BY 1 ORDER BY n DESC, domain LIMIT 30", SQL_LINKS)
def ci_outbound(s: Site) -> DataFrame:
    """Links from each domain to hosts that have no pages."""
    known = s.pages.select(F.col("domain").alias("d")).distinct()
    links = s.edges.select(urls.host("from_url").alias("domain"), urls.host("to_url").alias("tgt")).where("tgt <> ''")
    return top(counts(links.join(known, F.col("domain") == F.col("d"), "left_semi").join(known, F.col("tgt") == F.col("d"), "left_anti"), "domain"), 30, "n", "domain")


# Content performance


@query("thin_content_report", f"SELECT {SQL_PAGE} AS url, domain, {integer('word_count')} AS words FROM p WHERE {integer('word_count')} <= 250 ORDER BY words, url LIMIT 80")
def thin_content_report(s: Site, most: int = 250, cap: int | None = 80) -> DataFrame:
    out = s.pages.select(page_url().alias("url"), "domain", as_int("word_count").alias("words")).where(F.col("words") <= most).orderBy("words", "url")
    return out.limit(cap) if cap else out


@query("dup_hash_clusters", f"SELECT trim(content_hash) AS hash, count(*) AS n_rows, count(DISTINCT {SQL_PAGE}) AS n_urls, min({SQL_PAGE}) AS first_url FROM p WHERE trim(content_hash) <> '' GROUP BY 1 HAVING count(*) > 1")
def dup_hash_clusters(s: Site) -> DataFrame:
    return s.pages.where(filled("content_hash")).groupBy(F.trim("content_hash").alias("hash")).agg(F.count("*").alias("n_rows"), F.count_distinct(page_url()).alias("n_urls"), F.min(page_url()).alias("first_url")).where("n_rows > 1")


_SQL_CANON = f"rtrim(trim(canonical_url), '/') <> rtrim({SQL_PAGE}, '/')"


@query("dup_canonical", f"SELECT trim(canonical_url) AS canonical, count(*) AS n FROM p WHERE trim(canonical_url) <> '' AND {_SQL_CANON} GROUP BY 1 HAVING count(*) > 1")
def dup_canonical(s: Site) -> DataFrame:
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    return counts(s.pages.where(filled("canonical_url") & (bare(F.trim("canonical_url")) != bare(page_url()))), F.trim("canonical_url").alias("canonical")).where("n > 1")


_SQL_INTERNAL = f"pu AS (SELECT trim(final_url) AS u FROM p WHERE trim(final_url) <> '' UNION SELECT trim(requested_url) FROM p WHERE trim(requested_url) <> ''), il AS (SELECT from_url, to_url, {host('from_url')} AS domain FROM ed WHERE {host('from_url')} = {host('to_url')} AND {host('from_url')} IN (SELECT domain FROM p) AND from_url IN (SELECT u FROM pu))"


def _page_urls(s: Site) -> DataFrame:
    return s.pages.select(F.explode(F.array(F.trim("final_url"), F.trim("requested_url"))).alias("u")).where("u <> ''").distinct()


def _internal(s: Site) -> DataFrame:
    """Links of pages within their host, where the host has pages under its name."""
    links = s.edges.select("from_url", "to_url", urls.host("from_url").alias("domain"), urls.host("to_url").alias("_t")).where("domain = _t and domain <> ''").drop("_t")
    return links.join(_page_urls(s), F.col("from_url") == F.col("u"), "left_semi").join(s.pages.select("domain").distinct(), "domain", "left_semi")


@query("internal_inlinks", "SELECT to_url AS url, count(*) AS n FROM il WHERE to_url IN (SELECT u FROM pu) GROUP BY 1", _SQL_INTERNAL)
def internal_inlinks(s: Site) -> DataFrame:
    return counts(_internal(s).join(_page_urls(s), F.col("to_url") == F.col("u"), "left_semi"), F.col("to_url").alias("url"))


_SQL_ROW_OF = "ro AS (SELECT u, arg_max(domain, k) AS domain, arg_max(title, k) AS title FROM (SELECT trim(requested_url) AS u, domain, title, seq * 2 + 1 AS k FROM p UNION ALL SELECT trim(final_url), domain, title, seq * 2 FROM p) WHERE u <> '' GROUP BY 1)"


@query("top_inlinked", "SELECT url, n, ro.domain, substr(ro.title, 1, 120) AS title FROM (SELECT to_url AS url, count(*) AS n FROM il WHERE to_url IN (SELECT u FROM pu) GROUP BY 1 ORDER BY n DESC, url LIMIT 80) JOIN ro ON ro.u = url", _SQL_INTERNAL, _SQL_ROW_OF)
def top_inlinked(s: Site, cap: int | None = 80) -> DataFrame:
    """The pages that most internal links lead to, each with its row: the last that has the URL."""
    rows = internal_inlinks(s)
    rows = top(rows, cap, "n", "url") if cap else rows
    named = s.pages.select(F.explode(F.array(F.struct(F.trim("final_url").alias("u"), (F.col("seq") * 2).alias("k")), F.struct(F.trim("requested_url").alias("u"), (F.col("seq") * 2 + 1).alias("k")))).alias("x"), "domain", "title")
    # the few that are wanted first, so that only their rows are combined
    wanted = named.select("x.u", "x.k", "domain", "title").join(F.broadcast(rows) if cap else rows, F.col("u") == F.col("url"))
    return wanted.groupBy("url", "n").agg(F.max_by(F.struct("domain", F.substring("title", 1, 120).alias("title")), "k").alias("x")).select("url", "n", "x.domain", "x.title")


@query("internal_outlinks", "SELECT from_url AS url, count(*) AS n FROM il GROUP BY 1", _SQL_INTERNAL)
def internal_outlinks(s: Site) -> DataFrame:
    return counts(_internal(s), F.col("from_url").alias("url"))


@query("content_performance_summary", f"SELECT (SELECT count(*) FROM p) AS pages, (SELECT count(*) FROM p WHERE {integer('word_count')} <= 250) AS thin, (SELECT count(*) FROM il) AS internal_links, (SELECT count(*) FROM (SELECT content_hash FROM p WHERE trim(content_hash) <> '' GROUP BY 1 HAVING count(*) > 1)) AS clusters", _SQL_INTERNAL)
def content_performance_summary(s: Site) -> DataFrame:
    pages = s.pages.agg(F.count("*").alias("pages"), F.count_if(as_int("word_count") <= 250).alias("thin"))
    return pages.join(F.broadcast(_internal(s).agg(F.count("*").alias("internal_links")))).join(F.broadcast(dup_hash_clusters(s).agg(F.count("*").alias("clusters"))))


@query("dup_hash_urls", f"SELECT hash, url FROM (SELECT DISTINCT trim(content_hash) AS hash, {SQL_PAGE} AS url FROM p WHERE trim(content_hash) <> '') WHERE hash IN (SELECT trim(content_hash) FROM p WHERE trim(content_hash) <> '' GROUP BY 1 HAVING count(*) > 1)")
def dup_hash_urls(s: Site) -> DataFrame:
    """The URLs of each cluster, a row each: a cluster may be of any size."""
    rows = s.pages.where(filled("content_hash")).select(F.trim("content_hash").alias("hash"), page_url().alias("url")).distinct()
    return rows.join(dup_hash_clusters(s).select("hash"), "hash", "left_semi")


@query("dup_canonical_urls", f"SELECT trim(canonical_url) AS canonical, {SQL_PAGE} AS url FROM p WHERE trim(canonical_url) <> '' AND {_SQL_CANON} AND trim(canonical_url) IN (SELECT trim(canonical_url) FROM p WHERE trim(canonical_url) <> '' AND {_SQL_CANON} GROUP BY 1 HAVING count(*) > 1)")
def dup_canonical_urls(s: Site) -> DataFrame:
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    rows = s.pages.where(filled("canonical_url") & (bare(F.trim("canonical_url")) != bare(page_url()))).select(F.trim("canonical_url").alias("canonical"), page_url().alias("url"))
    return rows.join(dup_canonical(s).select("canonical"), "canonical", "left_semi")


@query("internal_by_domain", f"SELECT d.domain, coalesce(n, 0) AS links, {near('CAST(coalesce(n, 0) AS DOUBLE) / pages', 2)} AS per_page FROM (SELECT domain, count(*) AS pages FROM p GROUP BY 1) d LEFT JOIN (SELECT domain, count(*) AS n FROM il GROUP BY 1) i ON i.domain = d.domain", _SQL_INTERNAL)
def internal_by_domain(s: Site) -> DataFrame:
    joined = counts(s.pages, "domain", name="pages").join(counts(_internal(s), "domain", name="links"), "domain", "left").fillna(0)
    return joined.select("domain", "links", rounded(F.col("links") / F.col("pages"), 2).alias("per_page"))


@query(
    "keyword_alignment",
    f"SELECT domain, count(*) AS tagged, count(*) FILTER (len(list_filter(toks, lambda t: contains(concat(trim(regexp_replace(lower(title), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), ' ', trim(regexp_replace(lower(h1_joined), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))), t))) > 0) AS aligned FROM (SELECT *, list_filter(list_transform({sql_parts('tags_all')}, lambda t: lower(t)), lambda t: length(t) >= 2) AS toks FROM p) WHERE len(toks) > 0 GROUP BY 1",
)
def keyword_alignment(s: Site) -> DataFrame:
    tokens = F.filter(F.transform(parts("tags_all"), F.lower), lambda t: F.length(t) >= 2)
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "\\s+", " "))
    blob = F.concat_ws(" ", plain("title"), plain("h1_joined"))
    rows = s.pages.select("domain", tokens.alias("t"), blob.alias("b")).where(F.size("t") > 0)
    return rows.groupBy("domain").agg(F.count("*").alias("tagged"), F.count_if(F.exists("t", lambda t: F.contains(F.col("b"), t))).alias("aligned"))


# Technical performance, key metrics, indexability


_SQL_MS = f"CASE WHEN {real('fetch_time_ms', '-1.0')} >= 0 THEN {real('fetch_time_ms', '-1.0')} END"


@query("tech_perf_domain", f"SELECT domain, count(x) AS timed, coalesce({near('avg(x)')}, 0.0) AS avg_ms, coalesce({near('list_sort(list(x))[(count(x) - 1) * 9 // 10 + 1]')}, 0.0) AS p90_ms, count(*) FILTER (x >= 3000) AS slow, {pct("count(*) FILTER (has_viewport_meta = '1')", 'count(*)')} AS viewport_pct FROM (SELECT domain, has_viewport_meta, {_SQL_MS} AS x FROM p) GROUP BY 1")
def tech_perf_domain(s: Site) -> DataFrame:
    ms = as_float("fetch_time_ms", -1.0)
    timed = s.pages.withColumn("x", F.when(ms >= 0, ms))
    rows = timed.groupBy("domain").agg(
        F.count("x").alias("timed"),
        F.coalesce(rounded(F.avg("x")), F.lit(0.0)).alias("avg_ms"),
        F.count_if(F.col("x") >= 3000).alias("slow"),
        share(F.count_if(F.col("has_viewport_meta") == "1"), F.count("*")).alias("viewport_pct"),
    )
    ranks = frames.nearest_ranks(timed.where("x is not null"), "x", 9, "domain")
    return rows.join(ranks, "domain", "left").withColumn("p90_ms", F.coalesce(rounded(F.col("p90")), F.lit(0.0))).drop("p90")


@query("slow_pages", f"SELECT domain, url, ms FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ms DESC, url) AS k FROM (SELECT domain, {SQL_PAGE} AS url, round_even({_SQL_MS}, 0) AS ms FROM p WHERE {_SQL_MS} >= 3000)) WHERE k <= 80")
def slow_pages(s: Site, least: float = 3000.0, cap: int | None = 80) -> DataFrame:
    rows = s.pages.where(as_float("fetch_time_ms", -1.0) >= least).select("domain", page_url().alias("url"), F.rint(as_float("fetch_time_ms")).alias("ms"))
    return top(rows, cap, "ms", "url", per="domain") if cap else rows


@query("no_viewport_pages", f"SELECT domain, url FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY url) AS k FROM (SELECT domain, {SQL_PAGE} AS url FROM p WHERE has_viewport_meta <> '1')) WHERE k <= 80")
def no_viewport_pages(s: Site, cap: int | None = 80) -> DataFrame:
    rows = s.pages.where(F.col("has_viewport_meta") != "1").select("domain", page_url().alias("url"), F.lit(0).alias("_z"))
    return (top(rows, cap, "_z", "url", per="domain") if cap else rows).drop("_z")


@query("assets_by_category", f"SELECT {host('referrer_page_url')} AS domain, category, count(*) AS n FROM ast GROUP BY ALL")
def assets_by_category(s: Site) -> DataFrame:
    return counts(s.assets, urls.host("referrer_page_url").alias("domain"), "category")


@query("external_scripts", f"SELECT domain, url, n FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, url) AS k FROM (SELECT {host('referrer_page_url')} AS domain, trim(asset_url) AS url, count(*) AS n FROM ast WHERE category = 'script' AND {host('referrer_page_url')} <> '' AND {host('asset_url')} NOT IN ('', {host('referrer_page_url')}) GROUP BY ALL)) WHERE k <= 20")
def external_scripts(s: Site, cap: int | None = 20) -> DataFrame:
    """Scripts of other hosts, by the host of the page that loads them."""
    own, other = urls.host("referrer_page_url"), urls.host("asset_url")
    rows = counts(s.assets.where((F.col("category") == "script") & (own != "") & (other != "") & (other != own)), own.alias("domain"), F.trim("asset_url").alias("url"))
    return top(rows, cap, "n", "url", per="domain") if cap else rows


@query("large_images", f"SELECT domain, url, asset_url, bytes FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY bytes DESC, asset_url, url) AS k FROM (SELECT {host('referrer_page_url')} AS domain, referrer_page_url AS url, asset_url, {integer('head_content_length')} AS bytes FROM ast WHERE category = 'image' AND {integer('head_content_length')} >= 500000)) WHERE k <= 25")
def large_images(s: Site, least: int = 500_000, cap: int | None = 25) -> DataFrame:
    rows = s.assets.where((F.col("category") == "image") & (as_int("head_content_length") >= least)).select(urls.host("referrer_page_url").alias("domain"), F.col("referrer_page_url").alias("url"), "asset_url", as_int("head_content_length").alias("bytes"))
    return top(rows, cap, "bytes", "asset_url", "url", per="domain") if cap else rows


# What the wanted values are worked out from is written out here, apart from the engine's own tables.
_SOCIAL = ("facebook.", "fb.com", "twitter.", "t.co", "linkedin.", "instagram.", "youtube.", "youtu.be", "tiktok.", "pinterest.", "reddit.", "snapchat.")
_SEARCH = ("google.", "bing.com", "duckduckgo.", "yahoo.", "baidu.", "yandex.", "ecosia.", "startpage.")
_SQL_BUCKET = f"""CASE WHEN trim(referrer_url) = '' THEN 'unknown' WHEN lower(trim(referrer_url)) = 'seed' THEN 'direct_seed' WHEN starts_with(lower(trim(referrer_url)), 'sitemap:') THEN 'sitemap' WHEN {host('referrer_url')} = '' THEN 'other'
WHEN {host('referrer_url')} = domain OR ends_with({host('referrer_url')}, concat('.', domain)) THEN 'internal_discovery' WHEN {' OR '.join(f"contains(concat({host('referrer_url')}, '.'), '{x}')" for x in _SOCIAL)} THEN 'social_referrer'
WHEN {' OR '.join(f"contains(concat({host('referrer_url')}, '.'), '{x}')" for x in _SEARCH)} THEN 'search_referrer' ELSE 'external_other' END"""


@query("discovery_mix", f"SELECT domain, bucket, n, {pct('n', 'sum(n) OVER (PARTITION BY domain)')} AS pct FROM (SELECT domain, {_SQL_BUCKET} AS bucket, count(*) AS n FROM p GROUP BY ALL)")
def discovery_mix(s: Site) -> DataFrame:
    mix = counts(s.pages, "domain", rules.referrer_bucket("referrer_url", "domain").alias("bucket"))
    return mix.withColumn("pct", share(F.col("n"), F.sum("n").over(Window.partitionBy("domain"))))


_SQL_LABELS = f"CASE WHEN {real('wcag_form_labels_pct', '-1.0')} >= 0 THEN {real('wcag_form_labels_pct', '-1.0')} END"


_SQL_STOCK = "trim(schema_price) <> '' AND (contains(lower(schema_availability), 'instock') OR contains(lower(schema_availability), 'in stock'))"


@query(
    "key_metrics",
    f"""SELECT domain, count(*) AS pages, CAST(round_even(coalesce(avg(CASE WHEN {integer('word_count')} > 0 THEN {integer('word_count')} END), 0), 0) AS BIGINT) AS avg_words, {near(f'CAST(sum({integer("depth")}) AS DOUBLE) / count(*)', 2)} AS avg_depth, {near(f'CAST(sum({integer("link_count_internal")}) AS DOUBLE) / count(*)')} AS avg_internal,
{near(f'CAST(sum({integer("link_count_external")}) AS DOUBLE) / count(*)')} AS avg_external, count(*) FILTER (trim(schema_price) <> '') AS products, count(*) FILTER ({_SQL_STOCK}) AS in_stock, {pct(f'count(*) FILTER ({_SQL_STOCK})', "count(*) FILTER (trim(schema_price) <> '')")} AS in_stock_pct, coalesce({near(f'avg({_SQL_LABELS}) * 100')}, 0.0) AS form_labels_pct FROM p GROUP BY 1""",
)
def key_metrics(s: Site) -> DataFrame:
    labels, n, words = as_float("wcag_form_labels_pct", -1.0), F.count("*"), as_int("word_count")
    offered = F.lower("schema_availability")
    stocked = F.count_if(filled("schema_price") & (F.contains(offered, F.lit("instock")) | F.contains(offered, F.lit("in stock"))))
    return s.pages.groupBy("domain").agg(
        n.alias("pages"),
        F.rint(F.coalesce(F.avg(F.when(words > 0, words)), F.lit(0.0))).cast("long").alias("avg_words"),
        rounded(F.sum(as_int("depth")) / n, 2).alias("avg_depth"),
        rounded(F.sum(as_int("link_count_internal")) / n).alias("avg_internal"),
        rounded(F.sum(as_int("link_count_external")) / n).alias("avg_external"),
        F.count_if(filled("schema_price")).alias("products"),
        stocked.alias("in_stock"),
        share(stocked, F.count_if(filled("schema_price"))).alias("in_stock_pct"),
        F.coalesce(rounded(F.avg(F.when(labels >= 0, labels)) * 100), F.lit(0.0)).alias("form_labels_pct"),
    )


@query("key_metrics_pages", f"SELECT domain, {SQL_PAGE} AS url, substr(title, 1, 200) AS title, {_SQL_BUCKET} AS bucket, substr(referrer_url, 1, 500) AS referrer, {integer('word_count')} AS words, {integer('depth')} AS depth, {integer('link_count_internal')} AS internal, {integer('link_count_external')} AS external, trim(schema_price) <> '' AS priced, substr(schema_availability, 1, 120) AS availability FROM p")
def key_metrics_pages(s: Site) -> DataFrame:
    """The report's full form: a row for each page."""
    measures = (as_int(c).alias(n) for n, c in (("words", "word_count"), ("depth", "depth"), ("internal", "link_count_internal"), ("external", "link_count_external")))
    return s.pages.select("domain", page_url().alias("url"), F.substring("title", 1, 200).alias("title"), rules.referrer_bucket("referrer_url", "domain").alias("bucket"), F.substring("referrer_url", 1, 500).alias("referrer"), *measures, filled("schema_price").alias("priced"), F.substring("schema_availability", 1, 120).alias("availability"))


_SQL_NOINDEX = "ni AS (SELECT *, list_filter(list_transform(string_split(lower(robots_directives), '|'), lambda x: trim(x)), lambda x: contains(x, 'noindex')) AS seg FROM p), nf AS (SELECT *, len(list_filter(seg, lambda x: NOT starts_with(x, 'header:'))) > 0 AS by_meta, len(list_filter(seg, lambda x: starts_with(x, 'header:'))) > 0 AS by_header FROM ni)"


@query("noindex_summary", "SELECT count(*) AS total, count(*) FILTER (by_meta OR by_header) AS noindex, count(*) FILTER (by_meta AND NOT by_header) AS meta_only, count(*) FILTER (by_header AND NOT by_meta) AS header_only, count(*) FILTER (by_meta AND by_header) AS both FROM nf", _SQL_NOINDEX)
def noindex_summary(s: Site) -> DataFrame:
    meta, header = rules.noindex_sources("robots_directives")
    return s.pages.select(meta.alias("m"), header.alias("h")).agg(F.count("*").alias("total"), F.expr("count_if(m or h)").alias("noindex"), F.expr("count_if(m and not h)").alias("meta_only"), F.expr("count_if(h and not m)").alias("header_only"), F.expr("count_if(m and h)").alias("both"))


@query("noindex_pages", f"SELECT domain, {SQL_PAGE} AS url, by_meta, by_header FROM nf WHERE by_meta OR by_header ORDER BY domain, url, by_meta, by_header LIMIT 500", _SQL_NOINDEX)
def noindex_pages(s: Site, cap: int | None = 500) -> DataFrame:
    meta, header = rules.noindex_sources("robots_directives")
    out = s.pages.select("domain", page_url().alias("url"), meta.alias("by_meta"), header.alias("by_header")).where("by_meta or by_header").orderBy("domain", "url", "by_meta", "by_header")
    return out.limit(cap) if cap else out


@query("robots_blocked", f"SELECT {host('url')} AS domain, url, message FROM er WHERE error_type = 'robots_disallowed' ORDER BY domain, url LIMIT 500")
def robots_blocked(s: Site, cap: int | None = 500) -> DataFrame:
    return capped(s.errors.where(F.col("error_type") == "robots_disallowed").select(urls.host("url").alias("domain"), "url", "message").orderBy("domain", "url"), cap)


@query(
    "filter_options",
    f"SELECT 'domain' AS option, domain AS value FROM p UNION SELECT 'cms', trim(cms_generator) FROM p WHERE trim(cms_generator) <> '' UNION SELECT 'kind', trim(content_kind_guess) FROM p WHERE trim(content_kind_guess) <> '' UNION SELECT 'type', t FROM (SELECT unnest({sql_parts('json_ld_types')}) AS t FROM p UNION ALL SELECT unnest({sql_parts('microdata_types')}) FROM p)",
)
def filter_options(s: Site) -> DataFrame:
    pair = lambda option, value: F.struct(F.lit(option).alias("option"), value.alias("value"))
    types = F.transform(F.concat(parts("json_ld_types"), parts("microdata_types")), lambda t: pair("type", t))
    rows = F.concat(F.array(pair("domain", F.col("domain")), pair("cms", F.trim("cms_generator")), pair("kind", F.trim("content_kind_guess"))), types)
    return s.pages.select(F.explode(rows).alias("x")).select("x.option", "x.value").where("value <> ''").distinct()


# What the browser derives from reports


_SQL_TREE = "SELECT {x} AS grp, count(*) AS domains, CAST(sum(n) AS BIGINT) AS pages FROM (SELECT domain, count(*) AS n FROM p GROUP BY 1) q {j} GROUP BY 1"


def treemap(s: Site, by: str) -> DataFrame:
    return counts(s.pages, "domain").join(domain_groups(s, by), "domain").groupBy("grp").agg(F.count("*").alias("domains"), F.sum("n").alias("pages"))


@query("treemap_groups", _SQL_TREE.format(x="coalesce(cms, '(undetected)')", j="LEFT JOIN pc ON pc.d = domain"), _SQL_PRIMARY)
def treemap_groups(s: Site) -> DataFrame:
    return treemap(s, "cms")


@query("treemap_kinds", _SQL_TREE.format(x="kind", j="JOIN pk ON pk.d = domain"), _SQL_PRIMARY)
def treemap_kinds(s: Site) -> DataFrame:
    return treemap(s, "kind")


@query("treemap_owners", _SQL_TREE.format(x="array_to_string(string_split(lower(domain), '.')[-2:], '.')", j=""))
def treemap_owners(s: Site) -> DataFrame:
    return treemap(s, "ownership")


@query("status_families", "SELECT domain, " + ", ".join(f"count(*) FILTER (substr(http_status, 1, 1) = '{k}') AS s{k}xx" for k in "2345") + ", count(*) FILTER (NOT regexp_matches(http_status, '^[2-5]')) AS other FROM p WHERE domain IN (SELECT domain FROM big) GROUP BY 1", _SQL_BIGGEST)
def status_families(s: Site) -> DataFrame:
    biggest = top(counts(s.pages, "domain"), 40, "n", "domain").select("domain")
    first = F.substring("http_status", 1, 1)
    return s.pages.join(F.broadcast(biggest), "domain", "left_semi").groupBy("domain").agg(*(F.count_if(first == k).alias(f"s{k}xx") for k in "2345"), F.count_if(~first.isin(*"2345")).alias("other"))


@query("governance_matrix", f"SELECT d.domain, pages, coalesce(tools, 0) AS tools, privacy FROM (SELECT domain, count(*) AS pages, bool_or(trim(privacy_policy_url) <> '') AS privacy FROM p GROUP BY 1 HAVING count(*) >= 2) d LEFT JOIN (SELECT domain, count(DISTINCT t) AS tools FROM (SELECT domain, unnest({sql_parts('analytics_signals')}) AS t FROM p) GROUP BY 1) t ON t.domain = d.domain ORDER BY tools + CAST(privacy AS INT) DESC, pages DESC, d.domain LIMIT 50")
def governance_matrix(s: Site) -> DataFrame:
    tools = exploded(s.pages, "analytics_signals", "t", "domain").groupBy("domain").agg(F.count_distinct("t").alias("tools"))
    rows = s.pages.groupBy("domain").agg(F.count("*").alias("pages"), F.bool_or(filled("privacy_policy_url")).alias("privacy")).where("pages >= 2").join(tools, "domain", "left").fillna(0, ["tools"])
    return rows.orderBy(F.desc(F.col("tools") + F.col("privacy").cast("int")), F.desc("pages"), "domain").limit(50).select("domain", "pages", "tools", "privacy")


@query("content_mix", "SELECT domain, count(*) AS pages, count(DISTINCT trim(content_kind_guess)) FILTER (trim(content_kind_guess) <> '') AS kinds FROM p GROUP BY 1 HAVING count(*) >= 2 ORDER BY kinds DESC, domain LIMIT 50")
def content_mix(s: Site) -> DataFrame:
    kind = F.when(filled("content_kind_guess"), F.trim("content_kind_guess"))
    return top(s.pages.groupBy("domain").agg(F.count("*").alias("pages"), F.count_distinct(kind).alias("kinds")).where("pages >= 2"), 50, "kinds", "domain")


_SQL_RADAR = f"""rr AS (SELECT domain, count(*) AS n, {sql_mean_above_zero('readability_fk_grade')} AS grade, CAST(sum({integer('img_count')}) AS DOUBLE) AS images, {pct(f"sum({integer('img_missing_alt_count')})", f"sum({integer('img_count')})")} AS alt_missing,
round_even(CAST(sum({integer('word_count')}) AS DOUBLE) / count(*), 0) AS words, {near(f"CAST(sum({integer('link_count_internal')}) AS DOUBLE) / count(*)")} AS links, {pct("count(*) FILTER (trim(json_ld_types) <> '')", "count(*)")} AS json_ld, {pct("count(*) FILTER (trim(microdata_types) <> '')", "count(*)")} AS microdata,
bool_or(trim(author) <> '') AS authored, bool_or(trim(publisher) <> '') AS published, {sql_mean_above_zero('extraction_coverage_pct')} AS coverage, {sql_mean_above_zero('extraction_coverage_core_pct')} AS core FROM p GROUP BY 1)"""


@query(
    "quality_radar",
    f"""SELECT domain, CASE WHEN grade > 0 THEN greatest(0.0, least(1.0, (20 - grade) / 14)) ELSE 0.0 END AS readability, CASE WHEN images > 0 THEN (100 - alt_missing) / 100 ELSE 1.0 END AS alt_text, least(1.0, words / w) AS word_count, least(1.0, links / l) AS internal_links,
greatest(0.0, 1 - CAST(coalesce(e.n, 0) AS DOUBLE) / rr.n) AS http_health, greatest(0.0, least(1.0, 1 - CAST(coalesce(date_diff('day', CAST(f.latest AS DATE), DATE '2025-01-01'), 730) AS DOUBLE) / 730)) AS freshness, least(1.0, (json_ld + microdata) / 100) AS structured,
CAST(CASE WHEN authored THEN 33 ELSE 0 END + CASE WHEN published THEN 33 ELSE 0 END + CASE WHEN f.latest IS NOT NULL THEN 34 ELSE 0 END AS DOUBLE) / 100 AS metadata, coverage / 100 AS coverage, core / 100 AS coverage_core
FROM (SELECT *, CASE WHEN max(words) OVER () > 0 THEN max(words) OVER () ELSE 1 END AS w, CASE WHEN max(links) OVER () > 0 THEN max(links) OVER () ELSE 1 END AS l FROM rr WHERE n >= 10 ORDER BY n DESC, domain LIMIT 40) rr LEFT JOIN (SELECT {host('url')} AS h, count(*) AS n FROM er GROUP BY 1) e ON e.h = domain LEFT JOIN (SELECT domain AS d, max(day) AS latest FROM dt WHERE day IS NOT NULL GROUP BY 1) f ON f.d = domain""",
    SQL_DATES,
    _SQL_RADAR,
)
def quality_radar(s: Site, least: int = 10, most: int = 40, as_of: str = "2025-01-01") -> DataFrame:
    """Ten scores from 0 to 1 of each domain with enough pages: the biggest `most`."""
    n, images = F.count("*"), F.sum(as_int("img_count"))
    rows = s.pages.groupBy("domain").agg(
        n.alias("n"),
        mean_above_zero("readability_fk_grade").alias("grade"),
        images.alias("images"),
        share(F.sum(as_int("img_missing_alt_count")), images).alias("alt_missing"),
        F.rint(F.sum(as_int("word_count")) / n).alias("words"),
        rounded(F.sum(as_int("link_count_internal")) / n).alias("links"),
        share(F.count_if(filled("json_ld_types")), n).alias("json_ld"),
        share(F.count_if(filled("microdata_types")), n).alias("microdata"),
        F.bool_or(filled("author")).alias("authored"),
        F.bool_or(filled("publisher")).alias("published"),
        mean_above_zero("extraction_coverage_pct").alias("coverage"),
        mean_above_zero("extraction_coverage_core_pct").alias("core"),
    )
    rows = rows.where(F.col("n") >= least)
    greatest = rows.agg(F.max("words").alias("w"), F.max("links").alias("l"))  # of all of them, not of the biggest only
    rows = top(rows, most, "n", "domain").join(F.broadcast(greatest)).join(counts(s.errors, urls.host("url").alias("domain"), name="errors"), "domain", "left").join(freshness(s).select("domain", "latest"), "domain", "left")
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    above = lambda x: F.when(x > 0, x).otherwise(F.lit(1.0))
    days = F.coalesce(F.date_diff(F.lit(as_of).cast("date"), F.col("latest").cast("date")), F.lit(730))
    points = F.when(F.col("authored"), 33).otherwise(0) + F.when(F.col("published"), 33).otherwise(0) + F.when(F.col("latest").isNotNull(), 34).otherwise(0)
    return rows.select(
        "domain",
        F.when(F.col("grade") > 0, unit((20 - F.col("grade")) / 14)).otherwise(F.lit(0.0)).alias("readability"),
        F.when(F.col("images") > 0, (100 - F.col("alt_missing")) / 100).otherwise(F.lit(1.0)).alias("alt_text"),
        F.least(F.lit(1.0), F.col("words") / above(F.col("w"))).alias("word_count"),
        F.least(F.lit(1.0), F.col("links") / above(F.col("l"))).alias("internal_links"),
        F.greatest(F.lit(0.0), 1 - F.coalesce("errors", F.lit(0)).cast("double") / F.col("n")).alias("http_health"),
        unit(1 - days / 730).alias("freshness"),
        F.least(F.lit(1.0), (F.col("json_ld") + F.col("microdata")) / 100).alias("structured"),
        (points / 100).alias("metadata"),
        (F.col("coverage") / 100).alias("coverage"),
        (F.col("core") / 100).alias("coverage_core"),
    )


@query("freshness_score", "SELECT domain, greatest(0.0, least(1.0, 1 - CAST(date_diff('day', CAST(max(day) AS DATE), DATE '2025-01-01') AS DOUBLE) / 730)) AS score FROM dt WHERE day IS NOT NULL GROUP BY 1", SQL_DATES)
def freshness_score(s: Site, as_of: str = "2025-01-01") -> DataFrame:
    latest = dates(s.pages, "domain").groupBy("domain").agg(F.max("day").alias("d"))
    return latest.select("domain", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.date_diff(F.lit(as_of).cast("date"), F.col("d").cast("date")) / 730)).alias("score"))


@query("landscape", f"SELECT domain, count(*) AS pages, {sql_mean_above_zero('readability_fk_grade')} AS x, {sql_mean_above_zero('extraction_coverage_pct')} AS y FROM p GROUP BY 1 HAVING count(*) >= 2")
def landscape(s: Site) -> DataFrame:
    return s.pages.groupBy("domain").agg(F.count("*").alias("pages"), mean_above_zero("readability_fk_grade").alias("x"), mean_above_zero("extraction_coverage_pct").alias("y")).where("pages >= 2")
