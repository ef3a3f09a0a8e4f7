"""Extraction from raw pages and documents, and the scalar forms and rules, one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery import surface
from gleanery.functions import fetching, rules, urls
from gleanery.functions.scalars import content_hash, norm_date, slug
from gleanery.operators import extract, links
from gleanery.plans.registry import Site, host, key, near, query
from gleanery.plans.registry import norm_date as sql_date
from gleanery.plans.reports import _SQL_BUCKET

_ENTITIES = "replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_SQL_TITLE = _ENTITIES.format(x="trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[ \\t\\n\\r]+', ' ', 'g'))")
_SQL_SEEN = _ENTITIES.format(x="regexp_replace(regexp_replace(html, '<!--.*?-->|<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<[^>]*>', ' ', 'g')")
_SQL_WORDS = f"len(list_filter(regexp_split_to_array({_SQL_SEEN}, '[ \\t\\n\\r]+'), lambda x: x <> ''))"
_SQL_NAV = "regexp_extract(html, '<nav>(.*?)</nav>', 1, 's')"


def parsed(s: Site, *parts: str) -> DataFrame:
    return extract.parse(s.spread_table("pages"), *parts)


@query(
    "page_inventory",
    f"SELECT page_id, {_SQL_TITLE} AS title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, CAST({_SQL_WORDS} AS VARCHAR) AS word_count, CAST(len(list_distinct(regexp_extract_all({_SQL_NAV}, 'href=\"([^\"]*)\"', 1))) AS VARCHAR) AS nav_link_count, CAST(len(regexp_extract_all(html, '<a [^>]*href=')) AS VARCHAR) AS link_count_total FROM pages",
)
def page_inventory(s: Site) -> DataFrame:
    return parsed(s, "row").select("page_id", "title", "lang", "word_count", "nav_link_count", "link_count_total")


#: What is added to pages by their ids, so that cells differ: forms, images, headings, tables, buttons, metas, dates.
_FRAGMENTS = (
    '<meta name="viewport" content="w"><meta name="description" content="About it"><img src="/a.png"><img src="/b.png" alt="B"><h2></h2><h3>Jump</h3>',
    '<table><tr><td>1</td></tr></table><table><tr><th>2</th></tr></table><button></button><button>Go</button><a href="/privacy">Privacy</a><i id="d"></i><i id="d"></i>',
    '<main><p>m</p></main><form role="search"><input type="search" name="q"></form><link rel="canonical" href="/c/"><meta name="robots" content="noindex"><time datetime="2024-02-03">x</time>',
    '<a href="/x"></a><a href="/y">here</a><a href="/z">Read more</a><meta property="og:type" content="article"><meta name="author" content=" Ann "><h1>Second</h1>',
    '<a href="#main">Skip</a><div itemscope itemtype="https://schema.org/Event"></div><div typeof="schema:Offer"></div><link rel="next" href="?p=2"><link rel="alternate" type="application/rss+xml" href="/feed/">',
    "",
)
_WITH_FRAGMENTS = "concat(regexp_replace(html, '</body></html>$', ''), CASE page_id % 6 " + " ".join(f"WHEN {n} THEN '{x}'" for n, x in enumerate(_FRAGMENTS)) + " END, '</body></html>')"


def fragmented(s: Site, *parts: str) -> DataFrame:
    return extract.parse(s.spread_table("pages").selectExpr("page_id", "url", f"{_WITH_FRAGMENTS} AS html"), *parts)


def _count(pattern: str) -> str:
    return f"CAST(len(regexp_extract_all(html, '{pattern}')) AS VARCHAR)"


def _value(pattern: str, otherwise: str = "''") -> str:
    return f"(CASE WHEN regexp_matches(html, '{pattern}') THEN trim(regexp_extract(html, '{pattern}', 1)) ELSE {otherwise} END)"


def _flag(pattern: str) -> str:
    return f"(CASE WHEN regexp_matches(html, '{pattern}') THEN '1' ELSE '0' END)"


_FRAG = f"fg AS (SELECT page_id, url, {_WITH_FRAGMENTS} AS html FROM pages)"
_SQL_ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"


@query(
    "page_rows",
    f"""SELECT page_id, lower({host('url')}) AS domain, {_count('<img ')} AS img_count, {_count('<img src="[^"]*">')} AS img_missing_alt_count, {_flag('<meta name="viewport"')} AS has_viewport_meta,
{_value('<meta property="og:type" content="([^"]*)"')} AS og_type, CASE WHEN contains(html, 'rel="canonical"') THEN concat({_SQL_ORIGIN}, '/c') ELSE '' END AS canonical_url, CASE WHEN contains(html, 'name="robots"') THEN 'meta:noindex' ELSE '' END AS robots_directives, {_value('<time datetime="([^"]*)"')} AS date_published
FROM fg""",
    _FRAG,
)
def page_rows(s: Site) -> DataFrame:
    rows = extract.page_rows(fragmented(s, "row"))
    return rows.select("page_id", "domain", "img_count", "img_missing_alt_count", "has_viewport_meta", "og_type", "canonical_url", "robots_directives", "date_published")


@query(
    "page_accessibility",
    f"""SELECT page_id, {_count('<h[1-6]></h[1-6]>')} AS wcag_empty_headings, CAST(len(regexp_extract_all(html, '<table>')) - len(list_filter(regexp_extract_all(html, '<table>.*?</table>'), lambda x: contains(x, '<th>'))) AS VARCHAR) AS wcag_tables_no_headers, {_count('<button></button>')} AS wcag_empty_buttons, {_count('<a href="[^"]*"></a>')} AS wcag_empty_links,
CAST(len(regexp_extract_all(html, ' id="')) - len(list_distinct(regexp_extract_all(html, ' id="[^"]*"'))) AS VARCHAR) AS wcag_duplicate_ids, CASE WHEN regexp_matches(html, '<main>|href="#main') THEN '1' ELSE '0' END AS wcag_landmarks_present, {_flag('type="search"|role="search"')} AS wcag_has_search, {_flag('<nav[ >]')} AS wcag_has_nav,
CASE WHEN length(regexp_extract(html, '<html lang="([^"]*)"', 1)) >= 2 THEN '1' ELSE '0' END AS wcag_lang_valid, CASE WHEN regexp_matches(html, '<h1>.*<h3>|<h2>.*<h4>') AND NOT regexp_matches(html, '<h2>') THEN '0' ELSE '1' END AS wcag_heading_order_valid FROM fg""",
    _FRAG,
)
def page_accessibility(s: Site) -> DataFrame:
    """Checks of a page's structure, each against its own pattern."""
    return fragmented(s, "row").select("page_id", "wcag_empty_headings", "wcag_tables_no_headers", "wcag_empty_buttons", "wcag_empty_links", "wcag_duplicate_ids", "wcag_landmarks_present", "wcag_has_search", "wcag_has_nav", "wcag_lang_valid", "wcag_heading_order_valid")


@query(
    "page_relations",
    f"""SELECT page_id, {_value('itemscope itemtype="https://schema.org/([^"]*)"')} AS microdata_types, {_value('typeof="([^"]*)"')} AS rdfa_types, CASE WHEN contains(html, 'rel="next"') THEN concat(regexp_replace(url, '[?#].*$', ''), '?p=2') ELSE '' END AS pagination_next, CASE WHEN contains(html, 'rss+xml') THEN concat({_SQL_ORIGIN}, '/feed/') ELSE '' END AS feed_urls,
CASE WHEN contains(html, '"/privacy"') THEN concat({_SQL_ORIGIN}, '/privacy') ELSE '' END AS privacy_policy_url, {_value('<meta name="author" content="([^"]*)"')} AS author, array_to_string(list_transform(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1), lambda x: {_ENTITIES.format(x="trim(regexp_replace(x, '[ \t\n\r]+', ' ', 'g'))")}), ' | ') AS h1_joined FROM fg""",
    _FRAG,
)
def page_relations(s: Site) -> DataFrame:
    return fragmented(s, "row").select("page_id", "microdata_types", "rdfa_types", "pagination_next", "feed_urls", "privacy_policy_url", "author", "h1_joined")


@query("extracted_nav_links", f"SELECT url AS page_url, regexp_replace(concat(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), regexp_extract(a, 'href=\"([^\"#]*)', 1)), '(.)/+$', '\\1') AS nav_href, regexp_extract(a, '>(.*)$', 1) AS nav_text FROM (SELECT url, unnest(list_distinct(regexp_extract_all({_SQL_NAV}, '<a href=\"[^\"]*\">[^<]*'))) AS a FROM pages)")
def extracted_nav_links(s: Site) -> DataFrame:
    return links.nav_links(s.spread_table("pages"))


@query("extracted_edges", "SELECT url AS from_url, concat(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), regexp_replace(regexp_extract(a, 'href=\"([^\"#]*)', 1), '/+$', '')) AS to_url, regexp_extract(a, '>(.*)$', 1) AS link_text FROM (SELECT url, unnest(regexp_extract_all(html, '<a href=\"/[^\"]*\">[^<]*')) AS a FROM pages)")
def extracted_edges(s: Site) -> DataFrame:
    return links.edges(s.spread_table("pages"))


@query("url_host", f"SELECT page_id, {host('url')} AS host FROM pages")
def url_host(s: Site) -> DataFrame:
    return s.table("pages").select("page_id", urls.host("url").alias("host"))


@query("url_key", f"SELECT page_id, {key('url')} AS k FROM pages")
def url_key(s: Site) -> DataFrame:
    return s.table("pages").select("page_id", urls.url_key("url").alias("k"))


@query("crawl_key", "SELECT page_id, regexp_replace(concat('https://', lower(regexp_extract(url, '://([^/?#]*)', 1)), CASE WHEN path = '' THEN '/' ELSE path END, CASE WHEN q = '' THEN '' ELSE concat('?', array_to_string(list_sort(string_split(q, '&')), '&')) END), '/+$', '') AS k FROM (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^#?]*[?]([^#]*)', 1) AS q FROM pages)")
def crawl_key(s: Site) -> DataFrame:
    return s.table("pages").select("page_id", urls.crawl_key("url").alias("k"))


@query("asset_category", "SELECT DISTINCT asset_url, CASE regexp_extract(lower(asset_url), '([.][a-z0-9]+)$', 1) WHEN '.pdf' THEN 'pdf' WHEN '.jpg' THEN 'image' WHEN '.png' THEN 'image' WHEN '.js' THEN 'script' WHEN '.css' THEN 'stylesheet' WHEN '.docx' THEN 'office' END AS category FROM assets")
def asset_category(s: Site) -> DataFrame:
    return s.estate.assets.select("asset_url", urls.asset_category("asset_url").alias("category")).distinct()


_HINTED = "SELECT i, concat(CASE i % 7 WHEN 0 THEN '/blog/x' WHEN 1 THEN '/newsroom' WHEN 2 THEN '/about/team/' WHEN 3 THEN '/products/a' WHEN 4 THEN '/' WHEN 5 THEN '/docs/search' ELSE '/contact' END) AS path, CASE i % 5 WHEN 0 THEN 'Article' WHEN 1 THEN 'WebPage' WHEN 2 THEN 'HowTo' ELSE '' END AS types, CASE i % 3 WHEN 0 THEN 'website' ELSE '' END AS og FROM base"
_SQL_HINTS = "CASE path WHEN '/blog/x' THEN 'blog_path' WHEN '/newsroom' THEN 'news_path|news_path' WHEN '/about/team/' THEN 'about_path|team_path' WHEN '/products/a' THEN 'product_path' WHEN '/docs/search' THEN 'docs_path|search_path' WHEN '/contact' THEN 'contact_path' ELSE '' END"


def hinted(s: Site) -> DataFrame:
    """Pages with paths and types by their ids."""
    arr = lambda *v: F.array(*map(F.lit, v))
    i = F.col("page_id")
    return s.table("pages").select(
        i.alias("i"),
        F.element_at(arr("/blog/x", "/newsroom", "/about/team/", "/products/a", "/", "/docs/search", "/contact"), (i % 7).cast("int") + 1).alias("path"),
        F.element_at(arr("Article", "WebPage", "HowTo", "", ""), (i % 5).cast("int") + 1).alias("types"),
        F.when(i % 3 == 0, "website").otherwise("").alias("og"),
    )


@query("url_content_hint", f"SELECT i, {_SQL_HINTS} AS hint FROM ({_HINTED})")
def url_content_hint(s: Site) -> DataFrame:
    return hinted(s).select("i", rules.path_hints("path").alias("hint"))


_SQL_CRUMBS = "CASE i % 9 WHEN 1 THEN 'Home|Newsroom' WHEN 2 THEN 'Get in touch' WHEN 5 THEN 'Our Services' ELSE '' END AS crumb, CASE i % 8 WHEN 1 THEN 'wide StaffPage' WHEN 2 THEN 'single-post' WHEN 3 THEN 'page-node-type-event x' WHEN 5 THEN 'archive' ELSE '' END AS body"


@query(
    "content_kind",
    f"""SELECT i, CASE WHEN contains(hint, 'blog_path') THEN 'blog' WHEN contains(hint, 'news_path') THEN 'news' WHEN contains(hint, 'product_path') THEN 'product' WHEN types = 'HowTo' THEN 'how_to' WHEN types = 'Article' THEN 'article' WHEN types = 'WebPage' OR og = 'website' THEN 'webpage'
WHEN contains(hint, 'contact_path') THEN 'contact' WHEN contains(hint, 'about_path') THEN 'about' WHEN contains(hint, 'docs_path') THEN 'documentation' WHEN contains(crumb, 'News') THEN 'news' WHEN crumb = 'Get in touch' THEN 'contact' WHEN contains(crumb, 'Services') THEN 'service'
WHEN body = 'single-post' THEN 'blog' WHEN body = 'archive' THEN 'listing' WHEN contains(body, 'StaffPage') THEN 'staff' WHEN starts_with(body, 'page-node-type-event') THEN 'event' WHEN path = '/' THEN 'homepage' ELSE 'unknown' END AS kind FROM (SELECT *, {_SQL_HINTS} AS hint, {_SQL_CRUMBS} FROM ({_HINTED}))""",
)
def content_kind(s: Site) -> DataFrame:
    i = F.col("i")
    crumb = F.when(i % 9 == 1, "Home|Newsroom").when(i % 9 == 2, "Get in touch").when(i % 9 == 5, "Our Services")
    body = F.when(i % 8 == 1, "wide StaffPage").when(i % 8 == 2, "single-post").when(i % 8 == 3, "page-node-type-event x").when(i % 8 == 5, "archive")
    kind = rules.content_kind(rules.path_hints("path"), F.col("types"), F.col("og"), F.col("path"), crumb, body)
    return hinted(s).select("i", kind.alias("kind"))


@query("norm_date", f"SELECT run, seq, {sql_date('date_published')} AS published, {sql_date('date_modified')} AS modified FROM pages_raw")
def normalised_dates(s: Site) -> DataFrame:
    return s.estate.pages_raw.select("run", "seq", norm_date("date_published").alias("published"), norm_date("date_modified").alias("modified"))


@query("failure_class", "SELECT run, seq, CASE WHEN error_type <> 'fetch_failed' THEN error_type WHEN contains(lower(message), 'timeout') THEN 'timeout' WHEN contains(lower(message), 'ssl') OR contains(lower(message), 'certificate') THEN 'ssl' WHEN starts_with(lower(message), 'http ') THEN 'http_error' ELSE 'fetch_failed' END AS class, try_cast(regexp_extract(lower(message), '^http ([0-9]{3})', 1) AS INT) AS status FROM errors")
def failure_class(s: Site) -> DataFrame:
    return s.estate.errors.select("run", "seq", rules.failure_class("message", "error_type").alias("class"), rules.status_of_message("message").alias("status"))


@query("referrer_bucket", f"SELECT run, seq, {_SQL_BUCKET} AS bucket FROM pages_raw")
def referrer_bucket(s: Site) -> DataFrame:
    return s.estate.pages_raw.select("run", "seq", rules.referrer_bucket("referrer_url", "domain").alias("bucket"))


@query("priority_score", "SELECT i, CAST(i % 5 AS DOUBLE) * 10 - CASE WHEN i % 10 = 0 THEN 100 ELSE 0 END - CASE WHEN path = '/' THEN 5 ELSE 0 END + CASE WHEN contains(path, '/author/') OR contains(path, '/page/') THEN 20 ELSE 0 END AS score FROM (SELECT i, CASE i % 4 WHEN 0 THEN '/' WHEN 1 THEN '/author/x' WHEN 2 THEN '/page/2' ELSE '/feed/' END AS path FROM base)")
def priority_score(s: Site) -> DataFrame:
    i = F.col("page_id")
    path = F.when(i % 4 == 0, "/").when(i % 4 == 1, "/author/x").when(i % 4 == 2, "/page/2").otherwise("/feed/")
    # the final slash of /feed/ is stripped before the patterns are tried
    return s.table("pages").select(i.alias("i"), rules.priority(path, i % 5, i % 10 == 0).alias("score"))


@query("ownership", f"SELECT DISTINCT {host('url')} AS domain, CASE WHEN ends_with({host('url')}, '.example.org') THEN 'Org' ELSE array_to_string(string_split({host('url')}, '.')[-2:], '.') END AS owner FROM pages")
def ownership(s: Site) -> DataFrame:
    return s.table("pages").select(urls.host("url").alias("domain")).distinct().select("domain", rules.ownership("domain", [(".example.org", "Org")]).alias("owner"))


#: Marks of systems, added to pages by their ids.
_MARKS = ("", '<link href="/WP-Content/x.css">', '<img src="/sites/default/files/a.png">', '<div class="ms-webpart"></div>', '<script src="/_next/static/x.js"></script>', "<p>squarespace</p>", '<div class=a id="root"><b> x </b></div>', "<p>Kentico</p>", '<div id="apple"></div>')
_SQL_MARKED = "SELECT page_id, concat(html, CASE page_id % 9 " + " ".join(f"WHEN {n} THEN '{x}'" for n, x in enumerate(_MARKS)) + " END) AS html, CASE page_id % 7 WHEN 1 THEN 'Joomla! 4' WHEN 4 THEN 'TYPO3 CMS' ELSE '' END AS gen, CASE page_id % 5 WHEN 2 THEN 'PHP/8' WHEN 3 THEN 'ASP.NET' ELSE '' END AS power FROM pages"


@query(
    "tech_stack",
    """SELECT page_id, CASE WHEN contains(lower(gen), 'joomla') THEN 'Joomla' WHEN contains(lower(gen), 'typo3') THEN 'TYPO3' WHEN contains(lower(html), 'wp-content') THEN 'WordPress' WHEN contains(html, '/sites/default/files/') THEN 'Drupal' WHEN contains(html, 'ms-webpart') THEN 'SharePoint' WHEN contains(html, '_next/static') THEN 'Next.js'
WHEN contains(power, 'ASP.NET') THEN 'ASP.NET' WHEN contains(power, 'PHP') THEN 'PHP' WHEN contains(html, 'id="root"><b> x </b></div>') THEN 'JS SPA' WHEN contains(html, '<p>squarespace') THEN 'Squarespace' WHEN contains(html, '<p>Kentico') THEN 'Kentico' ELSE 'static/unknown' END AS stack FROM mk""",
    f"mk AS ({_SQL_MARKED})",
)
def tech_stack(s: Site) -> DataFrame:
    """The system that each page's HTML, generator and response headers show."""
    s.table("pages").createOrReplaceTempView("marked_pages")
    rows = s.spark.sql(_SQL_MARKED.replace("FROM pages", "FROM marked_pages"))
    return rows.select("page_id", rules.tech_stack("html", "gen", "power").alias("stack"))


@query("analytics_tokens", "SELECT page_id, array_to_string(list_filter([CASE WHEN contains(lower(h), 'googletagmanager.com') THEN 'googletagmanager.com' END, CASE WHEN contains(lower(h), 'gtag/js') THEN 'gtag/js' END, CASE WHEN contains(lower(h), 'datalayer') THEN 'dataLayer' END], lambda x: x IS NOT NULL), '|') AS tokens FROM (SELECT page_id, concat(html, CASE page_id % 4 WHEN 0 THEN '<script>DATALAYER</script>' WHEN 1 THEN '<script src=\"//www.googletagmanager.com/gtag/js\"></script>' ELSE '' END) AS h FROM pages)".replace('\\"', '"').replace('\"', '"'))
def analytics_tokens(s: Site) -> DataFrame:
    i = F.col("page_id")
    html = F.concat("html", F.when(i % 4 == 0, "<script>DATALAYER</script>").when(i % 4 == 1, '<script src="//www.googletagmanager.com/gtag/js"></script>').otherwise(""))
    return s.table("pages").select("page_id", rules.tokens_found(html, rules.ANALYTICS).alias("tokens"))


#: References by ids, and what they lead to from a page's address: its origin o, its folder f, the folder above that, and itself.
_REFERENCES = (
    ("/a/b/../c/", "concat(o, '/a/c')"),
    ("d?x=1#top", "concat(f, 'd?x=1')"),
    ("./e/", "concat(f, 'e')"),
    ("//cdn.example.net/y", "concat(s, '//cdn.example.net/y')"),
    ("HTTPS://Far.example.org/Q", "CASE WHEN s = 'https:' THEN 'https://Far.example.org/Q' ELSE 'HTTPS://Far.example.org/Q' END"),
    ("?p=2", "concat(w, '?p=2')"),
    ("#part", "regexp_replace(concat(w, q), '/+$', '')"),
    ("../../../up", "concat(o, '/up')"),
    ("mailto:a@b.example", "'mailto:a@b.example'"),
    ("http://[bad", "''"),
)
_SQL_PARTED = "SELECT page_id, regexp_extract(url, '^([a-z]+:)', 1) AS s, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS o, regexp_extract(url, '^([^?#]*)', 1) AS w, regexp_extract(url, '^[^?#]*([?][^#]*)', 1) AS q, concat(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), CASE WHEN regexp_matches(url, '^[a-z]+://[^/?#]*/') THEN regexp_extract(url, '^[a-z]+://[^/?#]*(/(?:[^?#]*/)?)', 1) ELSE '/' END) AS f FROM pages"


@query("extracted_references", "SELECT page_id, CASE page_id % 10 " + " ".join(f"WHEN {n} THEN {x}" for n, (_, x) in enumerate(_REFERENCES)) + f" END AS resolved FROM ({_SQL_PARTED})")
def extracted_references(s: Site) -> DataFrame:
    """References of every kind against the pages' addresses, in the JVM."""
    i = F.col("page_id")
    link = F.element_at(F.array(*(F.lit(x) for x, _ in _REFERENCES)), (i % 10).cast("int") + 1)
    return s.table("pages").select("page_id", urls.link_norm(link, F.col("url")).alias("resolved"))


_SQL_ROBOTS = "SELECT o AS origin, concat('User-agent: Other', chr(10), 'Disallow: /', chr(10), chr(10), 'User-agent: *', chr(10), 'Disallow: /en/', chr(10), CASE WHEN length(o) % 2 = 0 THEN concat('Disallow: /fr/', chr(10), 'Disallow: /fr/8') ELSE 'Allow: /' END) AS txt FROM (SELECT DISTINCT regexp_extract(url, '^([^/?#]+//[^/?#]*)', 1) AS o FROM pages)"


@query(
    "robots_rules",
    "SELECT page_id, NOT (en OR fr) AS allowed, CASE WHEN en THEN '/en/' WHEN fr AND starts_with(p, '/fr/8') THEN '/fr/8' WHEN fr THEN '/fr/' ELSE '' END AS rule FROM (SELECT page_id, p, starts_with(p, '/en/') AS en, starts_with(p, '/fr/') AND length(o) % 2 = 0 AS fr FROM (SELECT page_id, regexp_extract(url, '^([^/?#]+//[^/?#]*)', 1) AS o, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages))",
)
def robots_rules(s: Site) -> DataFrame:
    """Pages against the robots file of their origin."""
    pages = s.table("pages")
    origins = pages.select(urls.origin("url").alias("origin")).distinct()
    more = F.when(F.length("origin") % 2 == 0, "Disallow: /fr/\nDisallow: /fr/8").otherwise("Allow: /")
    robots = origins.select("origin", F.concat(F.lit("User-agent: Other\nDisallow: /\n\nUser-agent: *\nDisallow: /en/\n"), more).alias("txt"))
    return extract.robots_allowed(pages.select("page_id", "url"), robots, "Gleaner").select("page_id", "allowed", "rule")


#: Addresses of the networks' kinds by ids: what number stands where, and whether such is fetched from.
_SQL_LITERAL = "SELECT page_id, page_id % 256 AS a, page_id * 7 % 256 AS b FROM pages"


@query(
    "blocked_targets",
    "SELECT page_id, CASE WHEN a IN (0, 10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 192 AND b = 0) OR a >= 224 OR (a = 198 AND b = 51) OR (a = 203 AND b = 0) THEN concat('blocked address ', a, '.', b, '.', CASE WHEN a = 192 AND b = 0 THEN 2 WHEN a = 198 AND b = 51 THEN 100 WHEN a = 203 AND b = 0 THEN 113 ELSE 1 END, '.9') END AS reason FROM "
    "(SELECT page_id, CASE page_id % 4 WHEN 0 THEN a WHEN 1 THEN 172 WHEN 2 THEN 192 ELSE CASE page_id % 12 WHEN 3 THEN 169 WHEN 7 THEN 198 ELSE 203 END END AS a, CASE page_id % 4 WHEN 2 THEN CASE WHEN page_id % 8 = 2 THEN 168 ELSE 0 END WHEN 3 THEN CASE page_id % 12 WHEN 3 THEN 254 WHEN 7 THEN 51 ELSE 0 END ELSE b END AS b FROM (" + _SQL_LITERAL + "))",
)
def blocked_targets(s: Site) -> DataFrame:
    """Literal addresses made of the pages' ids: those of networks that aren't the public web's."""
    i = F.col("page_id")
    a = F.when(i % 4 == 0, i % 256).when(i % 4 == 1, F.lit(172)).when(i % 4 == 2, F.lit(192)).otherwise(F.when(i % 12 == 3, 169).when(i % 12 == 7, 198).otherwise(203))
    b = F.when(i % 4 == 2, F.when(i % 8 == 2, 168).otherwise(0)).when(i % 4 == 3, F.when(i % 12 == 3, 254).when(i % 12 == 7, 51).otherwise(0)).otherwise(i * 7 % 256)
    c = F.when((a == 192) & (b == 0), 2).when((a == 198) & (b == 51), 100).when((a == 203) & (b == 0), 113).otherwise(1)
    link = F.concat(F.lit("http://"), F.concat_ws(".", *(x.cast("string") for x in (a, b, c)), F.lit("9")), F.lit("/x"))
    return s.table("pages").select("page_id", fetching.blocked(link).alias("reason"))


@query("html_pages", "SELECT run, seq, trim(content_type) = '' OR contains(lower(content_type), 'text/html') OR contains(lower(content_type), 'application/xhtml') AS is_html FROM pages_raw")
def html_pages(s: Site) -> DataFrame:
    return s.estate.pages_raw.select("run", "seq", fetching.probably_html("content_type").alias("is_html"))


@query("page_slugs", "SELECT page_id, substr(regexp_replace(regexp_replace(regexp_replace(lower(trim(title)), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)")
def page_slugs(s: Site) -> DataFrame:
    return s.table("pages").select("page_id", slug(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("slug"))


@query("content_hash", "SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS hash FROM documents")
def hashes(s: Site) -> DataFrame:
    return s.table("documents").select("doc_id", content_hash("text").alias("hash"))


@query("content_dedup", "SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS hash, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) > 1 AS duplicate FROM documents")
def content_dedup(s: Site) -> DataFrame:
    return extract.content_duplicates(s.table("documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "hash", "duplicate")


@query("content_changed", "SELECT doc_id, CASE WHEN text IN (SELECT text FROM documents WHERE doc_id % 2 = 0) THEN 'unchanged' ELSE 'changed' END AS change FROM documents WHERE doc_id % 2 = 1")
def content_changed(s: Site) -> DataFrame:
    """Odd documents against the hashes of even ones, as a run against the last."""
    hashed = s.table("documents").select("doc_id", content_hash("text").alias("hash"))
    before = hashed.where("doc_id % 2 = 0").select("hash").distinct().withColumn("known", F.lit(True))
    return hashed.where("doc_id % 2 = 1").join(before, "hash", "left").select("doc_id", F.when(F.col("known"), "unchanged").otherwise("changed").alias("change"))


_SQL_COLLAPSED = "lower(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))"


@query("keyword_log", f"SELECT doc_id, term, CAST((length(low) - length(replace(low, term, ''))) // length(term) AS BIGINT) AS match_count FROM (SELECT doc_id, {_SQL_COLLAPSED} AS low FROM documents), (SELECT unnest(['the', 'tion', 'of the']) AS term) WHERE contains(low, term)")
def keyword_log(s: Site) -> DataFrame:
    return extract.keyword_log(s.spread_table("documents"), ["the", "tion", "", "of the", "the", None], "text", "doc_id")


@query("signals_summary", "SELECT url, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<meta [^>]*name=\"([^\"]*)\"', 1))), '|') AS meta_names, '' AS link_rels, '0' AS has_json_ld FROM pages")
def signals_summary(s: Site) -> DataFrame:
    rows = extract.signals(s.spread_table("pages"))
    return rows.select("url", "meta_names", "link_rels", "has_json_ld")


@query("run_status", "SELECT run, CASE WHEN run = 'run_2024-02-01' THEN 'interrupted' ELSE 'completed' END AS status FROM pages_raw GROUP BY 1")
def run_status(s: Site) -> DataFrame:
    pages = s.estate.pages_raw.groupBy("run").agg(F.count("*").alias("n"))
    state = F.when(F.col("run") == "run_2024-01-01", "completed").otherwise("new")
    return pages.select("run", rules.run_status(state, F.col("n")).alias("status"))


@query("sql_scalar_functions", "SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1) AS host, CAST(length(url) AS BIGINT) AS n, substr(sha256(url), 1, 16) AS hash FROM pages")
def sql_scalar_functions(s: Site) -> DataFrame:
    surface.register(s.spark)
    return s.spark.sql("SELECT page_id, url_host(url) AS host, safe_int(CAST(length(url) AS STRING)) AS n, text_hash(url) AS hash FROM {pages} WHERE is_filled(url)", pages=s.table("pages"))


_SQL_GRADES = """SELECT doc_id, CASE WHEN w >= 30 THEN {near} END AS grade FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS w, greatest(1, len(regexp_extract_all(t, '[.!?]+(?:[ \t\n\x0B\f\r]|$)'))) AS n,
len(regexp_extract_all(t, '[aeiouy]+')) - len(regexp_extract_all(regexp_replace(t, 'e([^\\p{{L}}\\p{{N}}_]|$)', 'E\\1', 'g'), '[^aeiouyl]E')) AS v FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents))"""


@query("readability_grades", _SQL_GRADES.format(near=near("0.39 * w / n + 11.8 * greatest(w, v) / w - 15.59").replace("0.39 * w", "CAST(0.39 AS DOUBLE) * w").replace("11.8 *", "CAST(11.8 AS DOUBLE) *").replace("- 15.59", "- CAST(15.59 AS DOUBLE)")))
def readability_grades(s: Site) -> DataFrame:
    """Grades of documents; none for texts of fewer than 30 words."""
    return s.spread_table("documents").select("doc_id", rules.readability("text").alias("grade"))


@query("sql_page_edges", "SELECT page_id, concat(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), regexp_replace(regexp_extract(a, 'href=\"([^\"#]*)', 1), '/+$', '')) AS to_url FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"/[^\"]*\">[^<]*')) AS a FROM pages)".replace('\\"', '"').replace('\"', '"'))
def sql_page_edges(s: Site) -> DataFrame:
    """The table function over pages."""
    surface.register(s.spark)
    return s.spark.sql("SELECT page_id, to_url FROM {pages} p, LATERAL page_edges(p.url, p.html)", pages=s.spread_table("pages"))
