"""What is extracted of hand-written pages, robots files and sitemaps, and what rules give for cells of each kind. Each case has its
wanted values written out, checked by hand against the rules, as SQL of a table of values."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import surface
from gleanery.functions import fetching, rules, urls
from gleanery.functions.scalars import slug
from gleanery.operators import extract
from gleanery.session import shared_folder
from gleanery.sources import tables
from gleanery.sources.estate import RUNS
from gleanery.sources.runs import Folder
from tests.pages import PAGES

#: Frames, and the SQL of their wanted values, by name.
CASES: dict[str, tuple[Callable, str]] = {}
Site = SimpleNamespace


def written(s: Site) -> Folder:
    """A base folder without runs."""
    return Folder(s.spark, f"{shared_folder(s.spark)}/runs-{uuid.uuid4().hex}")


def query(name: str, sql: str):
    def register(function: Callable) -> Callable:
        CASES[name] = function, sql
        return function

    return register


def values(rows, *names: str) -> str:
    """SQL of a table of texts."""
    quoted = ", ".join("(" + ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {quoted}) v({', '.join(names)})"


def captures(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(PAGES, "page int, url string, html string, robots string")
    return rows.withColumn("headers", F.create_map(F.lit("X-Robots-Tag"), F.col("robots"))).drop("robots")


def parsed(s: Site, *parts: str) -> DataFrame:
    return extract.parse(captures(s.spark), *parts, headers="headers")


#: Cells that aren't blank.
CELLS = (
    (1, "title", "Blue kettle"), (1, "meta_description", "A kettle"), (1, "lang", "en-GB"), (1, "canonical_url", "https://shop.example/kettle"), (1, "og_type", "product"), (1, "twitter_card", "summary"),
    (1, "json_ld_types", "Product|Article"), (1, "tags_all", "Kettle|blue|steel|kitchen|Kettle, hot|Home|Rel|Steel|Tea"), (1, "h1_joined", "Kettle"), (1, "word_count", "36"), (1, "heading_outline", "H3:Jump"),
    (1, "date_published", "2024-01-02"), (1, "visible_dates", "9th May, 2023|2023-04-05"), (1, "link_count_internal", "11"), (1, "link_count_external", "3"), (1, "link_count_total", "14"), (1, "img_count", "4"),
    (1, "img_missing_alt_count", "3"), (1, "privacy_policy_url", "https://shop.example/cookies?x"), (1, "nav_link_count", "3"), (1, "author", "Ann | Bo"), (1, "publisher", "Press"), (1, "json_ld_id", "#k"),
    (1, "robots_directives", "meta:noindex, follow|header:noarchive"), (1, "hreflang_links", "de=https://shop.example/de/kettle/|fr=https://fr.shop.example/k#x"), (1, "feed_urls", "https://shop.example/feed/"),
    (1, "pagination_next", "https://shop.example/p/kettle?p=2"), (1, "microdata_types", "Event"), (1, "rdfa_types", "schema:Offer"), (1, "schema_price", "24.5"), (1, "schema_currency", "EUR"), (1, "schema_availability", "InStock"),
    (1, "schema_rating", "4.5"), (1, "schema_review_count", "12"), (1, "domain", "shop.example"), (1, "content_kind_guess", "product"), (1, "analytics_signals", "dataLayer"),
    (2, "title", "Flood news"), (2, "og_title", "Flood news"), (2, "meta_description", "A river has come over its banks in the north of the country, and roads are closed."), (2, "lang", "e"),
    (2, "json_ld_types", "Event|JobPosting|Recipe|BreadcrumbList|Thing"), (2, "word_count", "31"), (2, "date_published", "2022-02-02T10:00"), (2, "date_modified", "2022-03-03"), (2, "visible_dates", "3 June 2022|4 July 2021"),
    (2, "link_count_internal", "0"), (2, "link_count_external", "1"), (2, "link_count_total", "1"), (2, "img_count", "0"), (2, "img_missing_alt_count", "0"), (2, "nav_link_count", "0"), (2, "author", "Cy"), (2, "cms_generator", "Ghost"),
    (2, "breadcrumb_schema", "Start > News"), (2, "schema_rating", "3"), (2, "schema_review_count", "1"), (2, "schema_event_date", "2024-06-01"), (2, "schema_event_location", "Main St"), (2, "schema_job_title", "Nurse"),
    (2, "schema_job_location", "Leeds"), (2, "schema_recipe_time", "PT5M"), (2, "domain", "news.example"), (2, "content_kind_guess", "job_posting"),
    (3, "word_count", "7"), (3, "date_published", "5 May 2020"), (3, "date_modified", "2020-06-07"), (3, "visible_dates", "5 May 2020|2020-06-07"), (3, "author", "ByDi"), (3, "pagination_prev", "https://x.example/p1"),
    (3, "link_count_internal", "0"), (3, "link_count_external", "0"), (3, "link_count_total", "0"), (3, "img_count", "0"), (3, "img_missing_alt_count", "0"), (3, "nav_link_count", "0"), (3, "domain", "x.example"), (3, "content_kind_guess", "unknown"),
    (4, "word_count", "0"), (4, "link_count_internal", "0"), (4, "link_count_external", "0"), (4, "link_count_total", "0"), (4, "img_count", "0"), (4, "img_missing_alt_count", "0"), (4, "nav_link_count", "0"), (4, "domain", "x.example"),
    (4, "content_kind_guess", "unknown"),
)
#: Of each page: language, heading order, title, form labels, landmarks, vague links, image texts, empty headings, duplicate
#: ids, empty buttons, empty links, tables without headers, autocompletion, search, navigation, viewport.
CHECKS = (
    (1, "1", "0", "1", "0.5", "0", "0.062", "0.25", "1", "1", "2", "1", "1", "0.333", "1", "1", "1"),
    (2, "0", "1", "1", "1.0", "1", "0.333", "1.0", "0", "0", "0", "0", "0", "1.0", "0", "0", "0"),
    (3, "0", "1", "0", "0.0", "0", "0.0", "1.0", "0", "0", "0", "0", "0", "0.0", "1", "0", "0"),
    (4, "0", "1", "0", "1.0", "0", "0.0", "1.0", "0", "0", "0", "0", "0", "1.0", "0", "0", "0"),
)
_CHECKED = ("wcag_lang_valid", "wcag_heading_order_valid", "wcag_title_present", "wcag_form_labels_pct", "wcag_landmarks_present", "wcag_vague_link_pct", "wcag_img_alt_pct", "wcag_empty_headings", "wcag_duplicate_ids", "wcag_empty_buttons", "wcag_empty_links", "wcag_tables_no_headers", "wcag_autocomplete_pct", "wcag_has_search", "wcag_has_nav", "has_viewport_meta")
#: Measures that are tested apart, or hold texts of any length.
_APART = {"content_hash", "visible_text", "readability_fk_grade", "extraction_coverage_pct", "extraction_coverage_core_pct", "url_content_hint", "training_related_flag"}


@query("sample_cells", values(CELLS, "page", "field", "value"))
def sample_cells(s: Site) -> DataFrame:
    rows = extract.page_rows(parsed(s, "row"))
    fields = [c for c in rows.columns if c not in _APART and c not in _CHECKED and c not in ("page", "url")]
    return rows.unpivot(["page"], fields, "field", "value").where("value <> ''")


@query("sample_accessibility", values(CHECKS, "page", *_CHECKED))
def sample_accessibility(s: Site) -> DataFrame:
    return parsed(s, "row").select("page", *_CHECKED)


@query("sample_coverage", values(((1, "76.9", "82.1"), (2, "46.2", "42.9"), (3, "20.0", "25.0"), (4, "9.2", "12.5")), "page", "every", "core"))
def sample_coverage(s: Site) -> DataFrame:
    """Filled of 65 cells; of 56 without those of rare kinds, the share of all among them."""
    return extract.page_rows(parsed(s, "row")).select("page", F.col("extraction_coverage_pct").alias("every"), F.col("extraction_coverage_core_pct").alias("core"))


@query("sample_tags", values((("Kettle", "meta:keywords"), ("blue", "meta:keywords"), ("steel", "meta:keywords"), ("kitchen", "og:article:tag"), ("Kettle, hot", "json_ld:keywords"), ("Home", "json_ld:articleSection"), ("Rel", "rel:tag"), ("Steel", "href:category"), ("Tea", "class:topics")), "tag_value", "tag_source"))
def sample_tags(s: Site) -> DataFrame:
    return extract.tags(parsed(s, "tags")).select("tag_value", "tag_source")


@query("sample_phones", values((("https://shop.example/p/kettle", "tel:+44 20 1", "+44 20 1", "Call"),), "page_url", "raw_href", "phone_number", "link_text"))
def sample_phones(s: Site) -> DataFrame:
    return extract.phones(parsed(s, "phones"))


@query("sample_nav_links", values((("https://shop.example/one", "One"), ("https://b.example", "B"), ("https://shop.example/two", "Two")), "nav_href", "nav_text"))
def sample_nav_links(s: Site) -> DataFrame:
    return extract.nav_links(parsed(s, "nav")).select("nav_href", "nav_text")


_SHOP_EDGES = ("one", "One"), ("one", "Again"), ("one", "Once more"), ("two", "Two"), ("", "Home"), ("cookies?x", "here"), ("doc.PDF", "Doc"), ("tag/steel", "Steel"), ("x", "Rel"), ("z", ""), ("y", "")
_IN_SCOPE = tuple((f"https://shop.example/{p}".rstrip("/"), t) for p, t in _SHOP_EDGES)
_BEYOND = (("https://b.example", "B"), ("https://c.example/learn", "Learn more"))


@query("sample_edges", values((*_IN_SCOPE, *_BEYOND), "to_url", "link_text"))
def sample_edges(s: Site) -> DataFrame:
    return extract.edges(parsed(s, "edges")).select("to_url", "link_text")


@query("sample_edges_in_scope", values((*_IN_SCOPE, *_BEYOND[1:]), "to_url", "link_text"))
def sample_edges_in_scope(s: Site) -> DataFrame:
    """Links to hosts out of scope are no edges."""
    return extract.edges(parsed(s, "edges"), allow=["shop.example", ".c.example"]).select("to_url", "link_text")


_EMBEDDED = (("a.png", "", "image"), ("p/b.jpg", "Side view", "image"), ("p/z.gif", "", "image"), ("s.css", "", "stylesheet"), ("i.ico", "", "image"), ("f.woff2", "", "font"), ("app.js", "", "script"), ("v.mp4", "", "video"), ("v.webm", "", "video"), ("a.mp3", "", "audio"))


@query("sample_inline_assets", values(tuple((f"https://shop.example/{p}", t, k) for p, t, k in _EMBEDDED), "asset_url", "link_text", "category"))
def sample_inline_assets(s: Site) -> DataFrame:
    return extract.inline_assets(parsed(s, "assets")).select("asset_url", "link_text", "category")


@query("sample_assets", values(tuple((f"https://shop.example/{p}", t, k) for p, t, k in (*_EMBEDDED, ("doc.PDF", "Doc", "pdf"))), "asset_url", "link_text", "category"))
def sample_assets(s: Site) -> DataFrame:
    return extract.assets(parsed(s, "edges", "assets")).select("asset_url", "link_text", "category")


_SIGNALS = (
    (1, "Description|keywords|robots|twitter:card|viewport", "article:tag|og:site_name|og:type", "@id|@type|aggregateRating|author|datePublished|genre|keywords|offers|publisher", "og:site_name|og:type", "twitter:card", "X-Robots-Tag=noarchive", "1", "1", "1"),
    (2, "Author", "article:published_time|og:title|og:updated_time", "@type|cookTime|itemListElement|jobLocation|location|review|startDate|title", "og:title|og:updated_time", "", "", "1", "0", "0"),
    (3, "", "", "", "", "", "", "0", "0", "0"),
    (4, "", "", "", "", "", "", "0", "0", "0"),
)


@query("sample_signals", values(_SIGNALS, "page", "meta_names", "meta_properties", "json_ld_keys", "og_properties", "twitter_properties", "headers", "has_json_ld", "has_microdata", "has_rdfa"))
def sample_signals(s: Site) -> DataFrame:
    found = extract.signals(captures(s.spark), headers="headers")
    ids = captures(s.spark).select("page", F.col("url"))
    return ids.join(found, "url").select("page", "meta_names", "meta_properties", "json_ld_keys", "og_properties", "twitter_properties", "headers", "has_json_ld", "has_microdata", "has_rdfa")


_STACKS = (
    ("<meta>", "WordPress 6", "", "", "WordPress"),
    ("<p>", "Developer Starter Kit", "", "", "WordPress"),
    ("<p>drupal", "Joomla!", "", "", "Joomla"),
    ("<p>", "TYPO3 CMS", "", "", "TYPO3"),
    ("<p>", "concrete5 - 8", "", "", "Concrete5"),
    ('<link href="/WP-Content/x">', "", "ASP.NET", "", "WordPress"),
    ('<img src="/sites/default/files/a">', "", "", "", "Drupal"),
    ('<div class="ms-webpart">', "", "", "", "SharePoint"),
    ('<script src="/_next/static/x">', "", "", "", "Next.js"),
    ('<div id="___gatsby">', "", "", "", "Gatsby"),
    ("<p>squarespace", "", "", "Drupal 9", "Drupal"),
    ("<p>wix.com", "", "ASP.NET", "", "ASP.NET"),
    ("<p>", "", "Express", "", "Express/Node"),
    ("<p>", "", "PHP/8", "", "PHP"),
    ('<div class=a id="root"><b> x </b></div>umbraco', "", "", "", "JS SPA"),
    ("<div id=app></div>", "", "", "", "JS SPA"),
    ('<div id="app">' + "many words " * 9 + "</div>sitecore", "", "", "", "Sitecore"),
    ('<div id="apple"></div>', "", "", "", "static/unknown"),
    ("themes/pgme", "", "", "", "SilverStripe"),
    ("<p>episerver", "", "", "", "Optimizely"),
    ("<p>Kentico and contensis", "", "", "", "Kentico"),
    ("x" * 600_000 + "contensis", "", "", "", "Contensis"),
    ("", "", "", "", "static/unknown"),
)


@query("sample_tech_stack", values(((i, x[4]) for i, x in enumerate(_STACKS)), "n", "stack"))
def sample_tech_stack(s: Site) -> DataFrame:
    rows = s.spark.createDataFrame([(i, *x[:4]) for i, x in enumerate(_STACKS)], "n int, html string, gen string, power string, head string")
    return rows.select("n", rules.tech_stack("html", "gen", "power", "head").alias("stack"))


_KINDS: tuple[tuple[dict[str, str], str], ...] = (
    ({"types": "BlogPosting"}, "blog"), ({"hints": "blog_path"}, "blog"), ({"types": "NewsArticle"}, "news"), ({"types": "Product"}, "product"), ({"types": "JobPosting"}, "job_posting"), ({"types": "Recipe"}, "recipe"), ({"types": "HowTo"}, "how_to"),
    ({"types": "Course"}, "course"), ({"types": "QAPage"}, "qa"), ({"types": "VideoObject"}, "video"), ({"types": "SoftwareApplication"}, "software"), ({"types": "Review"}, "review"), ({"types": "FAQPage"}, "faq"), ({"types": "Article"}, "article"),
    ({"types": "Article", "path": "/my-blog/x"}, "unknown"), ({"types": "Event"}, "unknown"), ({"types": "Event", "hints": "events_path"}, "event"), ({"types": "Restaurant"}, "local_business"), ({"types": "WebPage"}, "webpage"), ({"og": "Article"}, "webpage"),
    ({"types": "MedicalWebPage"}, "webpage"), ({"types": "MedicalBusiness"}, "medical_page"), ({"types": "ItemList"}, "listing"), ({"hints": "contact_path|about_path"}, "contact"), ({"hints": "about_path"}, "about"), ({"hints": "pricing_path"}, "pricing"),
    ({"hints": "case_study_path"}, "case_study"), ({"hints": "docs_path"}, "documentation"), ({"hints": "legal_path"}, "legal"), ({"hints": "search_path"}, "search"), ({"crumb": "Home|Blogs"}, "blog"), ({"crumb": "Newsroom"}, "news"),
    ({"crumb": "Publications"}, "publication"), ({"crumb": "Events"}, "event"), ({"crumb": "About us"}, "about"), ({"crumb": "Get in touch"}, "contact"), ({"crumb": "Services"}, "service"), ({"body": "single-post"}, "blog"), ({"body": "page-id-4"}, "webpage"),
    ({"body": "archive"}, "listing"), ({"body": "HomePage"}, "homepage"), ({"body": "AboutOverviewPage"}, "about"), ({"body": "NewsItemPage"}, "news"), ({"body": "ResourcePage"}, "resource"), ({"body": "StaffPage"}, "staff"), ({"body": "BlogEntry"}, "blog"),
    ({"body": "page-node-type-blog"}, "blog"), ({"body": "page-node-type-news"}, "news"), ({"body": "page-node-type-event"}, "event"), ({"body": "page-node-type-section"}, "webpage"), ({"path": "/"}, "homepage"), ({"path": ""}, "homepage"), ({}, "unknown"),
)


@query("sample_content_kinds", values(((i, k) for i, (_, k) in enumerate(_KINDS)), "n", "kind"))
def sample_content_kinds(s: Site) -> DataFrame:
    """Every branch of the rules."""
    names = ("hints", "types", "og", "path", "crumb", "body")
    rows = s.spark.createDataFrame([(i, *(x.get(n, "/x" if n == "path" else "") for n in names)) for i, (x, _) in enumerate(_KINDS)], "n int, " + ", ".join(f"{n} string" for n in names))
    return rows.select("n", rules.content_kind(*(F.col(n) for n in names)).alias("kind"))


_PATHS = (
    ("/blog", "blog_path"), ("/blogs/a", "blog_path|blog_path"), ("/news/", "news_path"), ("/newsroom", "news_path|news_path"), ("/publications", "publication_path|publication_path"), ("/gp/1", "gp_path"), ("/services/x", "service_path|service_path"),
    ("/about-us", "about_path"), ("/contact", "contact_path"), ("/jobs", "jobs_path"), ("/careers", "careers_path"), ("/events", "events_path"), ("/event/1", "events_path"), ("/patients", "patients_path"), ("/patient-care", "patients_path"),
    ("/explore-roles", "careers_path"), ("/working-health", "careers_path"), ("/training", "training_path"), ("/guidance", "guidance_path"), ("/statistics", "statistics_path"), ("/products/a", "product_path"), ("/product/a", "product_path"),
    ("/shop/a", "product_path"), ("/collections/a", "product_path"), ("/recipes/a", "recipe_path|recipe_path"), ("/faq", "faq_path"), ("/help/a", "help_path"), ("/support/a", "help_path"), ("/forum", "forum_path"), ("/community/a", "forum_path"),
    ("/wiki/a", "wiki_path"), ("/docs/a", "docs_path"), ("/documentation/a", "docs_path"), ("/portfolio/a", "portfolio_path"), ("/case-studies", "case_study_path"), ("/reviews", "review_path"), ("/testimonials", "review_path"), ("/pricing", "pricing_path"),
    ("/plans/a", "pricing_path"), ("/team/", "team_path"), ("/staff/a", "team_path"), ("/people/a", "team_path"), ("/press/a", "press_path"), ("/media/a", "press_path"), ("/legal/a", "legal_path"), ("/terms", "legal_path"), ("/privacy", "legal_path"),
    ("/policy/a", "legal_path"), ("/signin", "auth_path"), ("/login", "auth_path"), ("/register", "auth_path"), ("/signup", "auth_path"), ("/account/a", "auth_path"), ("/search", "search_path"), ("/BLOG/News", "blog_path|news_path"), ("/a/b", ""), ("/", ""),
)


@query("sample_path_hints", values(_PATHS, "path", "hint"))
def sample_path_hints(s: Site) -> DataFrame:
    """Every hint."""
    rows = s.spark.createDataFrame([(p,) for p, _ in _PATHS], "path string")
    return rows.select("path", rules.path_hints(F.concat(F.lit("https://a.example"), "path", F.lit("?q=/faq"))).alias("hint"))


_FILES = (("a.pdf", "pdf"), ("a.JPG", "image"), ("a.jpeg", "image"), ("a.png", "image"), ("a.gif", "image"), ("a.svg", "image"), ("a.webp", "image"), ("a.doc", "office"), ("a.docx", "office"), ("a.ppt", "office"), ("a.pptx", "office"), ("a.odt", "office"), ("a.xls", "spreadsheet"), ("a.xlsx", "spreadsheet"), ("a.ods", "spreadsheet"), ("a.zip", "archive"), ("a.mp3", "audio"), ("a.mp4", "video"), ("a.woff", "font"), ("a.woff2", "font"), ("a.ttf", "font"), ("a.eot", "font"), ("a.css", "stylesheet"), ("a.js", "script"), ("a.xml", "xml"), ("a.json", "json"), ("a.atom", "xml"), ("a.rss", "xml"), ("a.html", None), ("a.pdf/x", None), ("pdf", None), ("x?f=a.pdf", None))


@query("sample_asset_kinds", values(_FILES, "file", "category"))
def sample_asset_kinds(s: Site) -> DataFrame:
    rows = s.spark.createDataFrame([(f,) for f, _ in _FILES], "file string")
    return rows.select("file", urls.asset_category(F.concat(F.lit("https://a.example/"), "file")).alias("category"))


_TOKENS = (("<script>DATALAYER</script> gtag/js", "Spring Courses and a Conference", "gtag/js|dataLayer", "course|courses|conference"), ("x" * 600_000 + "google-analytics.com/ga.js", "CPD", "google-analytics.com|ga.js", "cpd"), ("googletagmanager.com analytics.js", "Learning: webinar, workshop, seminar, masterclass, training, events", "googletagmanager.com|analytics.js", "training|learning|workshop|webinar|event|events|seminar|masterclass"), ("", "", "", ""))


@query("sample_tokens", values(((i, a, t) for i, (_, _, a, t) in enumerate(_TOKENS)), "n", "analytics", "training"))
def sample_tokens(s: Site) -> DataFrame:
    """Signs of analytics anywhere in a page, and of training in its title."""
    rows = s.spark.createDataFrame([(i, h, t) for i, (h, t, _, _) in enumerate(_TOKENS)], "n int, html string, title string")
    return rows.select("n", rules.tokens_found("html", rules.ANALYTICS).alias("analytics"), rules.tokens_found("title", rules.TRAINING).alias("training"))


_OWNERS = (("a.b.example.org", "Org"), ("www.trust.nhs.uk", "trust.nhs.uk"), ("shop.co.uk", "shop.co.uk"), ("x.y.com", "y.com"), ("localhost", "localhost"), ("NOTEXAMPLE.ORG", "notexample.org"))


@query("sample_owners", values(_OWNERS, "domain", "owner"))
def sample_owners(s: Site) -> DataFrame:
    rows = s.spark.createDataFrame([(d,) for d, _ in _OWNERS], "domain string")
    return rows.select("domain", rules.ownership("domain", [(".example.org", "Org")]).alias("owner"))


_CAPTURED = ((1, "Raw"), (2, "Rendered"), (3, ""))


@query("captured_pages", values(_CAPTURED, "n", "title"))
def captured_pages(s: Site) -> DataFrame:
    """Captures as a fetcher leaves them, written and read: of thin pages the rendered HTML is parsed, of what is no HTML nothing."""
    folder = f"{shared_folder(s.spark)}/captures-{uuid.uuid4().hex}"
    raw, better = "<title>Raw</title>", "<title>Rendered</title><p>and more of it than there was</p>"
    rows = [(1, "text/html", raw, None), (2, "text/html", raw, better), (3, "image/png", raw, better)]
    df = s.spark.createDataFrame(rows, "n int, content_type string, html string, rendered_html string")
    df.select(F.concat(F.lit("https://a.example/"), "n").alias("url"), F.lit(200).alias("http_status"), "content_type", "html", "rendered_html").write.parquet(folder)
    found = extract.parse(fetching.pages(tables.read_captures(s.spark, folder)), "row")
    every = df.select("n", F.concat(F.lit("https://a.example/"), "n").alias("url"))
    return every.join(found.select("url", "title"), "url", "left").select("n", F.coalesce("title", F.lit("")).alias("title"))


# URLs

_KEYS = (
    ("http://A.com:443/x/", "https://a.com/x"),
    ("https://a.com:80", "https://a.com"),
    ("http://a.com/?b=2&a=1#f", "https://a.com/?a=1&b=2"),
    ("http://a.com/x?q=a%20b&k=", "https://a.com/x?k=&q=a+b"),
    ("http://a.com/x?flag&&a=1=2", "https://a.com/x?a=1%3D2&flag="),
    ("http://a.com/x?u=%C3%A9~*", "https://a.com/x?u=%C3%A9~%2A"),
    ("http://a.com/x?u=é", "https://a.com/x?u=%C3%A9"),
    ("http://a.com/x?u=50%", "https://a.com/x?u=50%25"),
    ("http://[bad/x%20", "http://[bad/x%20"),
    ("http://[::1]:443/", "https://[::1]"),
    ("mailto:a@b.example", "mailto:a@b.example"),
    ("not a url", "not a url"),
    ("/", "/"),
)


@query("sample_crawl_keys", values(_KEYS, "url", "k"))
def sample_crawl_keys(s: Site) -> DataFrame:
    return s.spark.createDataFrame([(u,) for u, _ in _KEYS], "url string").select("url", urls.crawl_key("url").alias("k"))


_LINKS = (
    ("/a/", "https://x.example/p/q", "https://x.example/a"),
    ("a#f", "https://x.example/p/q", "https://x.example/p/a"),
    ("?p=2", "https://x.example/p/q", "https://x.example/p/q?p=2"),
    ("../../..", "https://x.example/p/q/r", "https://x.example"),
    ("//cdn.example/x", "https://x.example/p", "https://cdn.example/x"),
    ("HTTPS://y.example/Z", "https://x.example/p", "https://y.example/Z"),
    ("http://[bad", "https://x.example/p", ""),
    ("tel:1", "https://x.example/p", "tel:1"),
    ("#f", "https://x.example/p/", "https://x.example/p"),
)


@query("sample_link_forms", values(_LINKS, "link", "base", "resolved"))
def sample_link_forms(s: Site) -> DataFrame:
    rows = s.spark.createDataFrame([x[:2] for x in _LINKS], "link string, base string")
    return rows.select("link", "base", urls.link_norm(F.col("link"), F.col("base")).alias("resolved"))


# Robots and sitemaps

_ROBOTS = (("https://a.example", "User-agent: *\nDisallow: /private/\nDisallow: /private/deep/\nAllow: /\nSitemap: https://a.example/index.xml\n sitemap:https://a.example/other.xml"), ("https://b.example", "User-agent: Bot\nDisallow: /\n\nUser-agent: *\nDisallow:\nSITEMAP:"))


def _robots(s: Site) -> DataFrame:
    return s.spark.createDataFrame(_ROBOTS, "origin string, txt string")


@query("sample_robots_sitemaps", values((("https://a.example", "https://a.example/index.xml"), ("https://a.example", "https://a.example/other.xml")), "origin", "sitemap"))
def sample_robots_sitemaps(s: Site) -> DataFrame:
    return tables.robots_sitemaps(_robots(s)).select("origin", "sitemap")


_JUDGED = (("https://a.example/x", True, ""), ("https://a.example/private/y", False, "/private/"), ("https://a.example/private/deep/z", False, "/private/deep/"), ("https://b.example/", False, "/"), ("https://c.example/private/", True, ""))


@query("sample_robots_rules", "SELECT url, allowed, rule FROM (VALUES " + ", ".join(f"('{u}', {str(a).upper()}, '{r}')" for u, a, r in _JUDGED) + ") v(url, allowed, rule)")
def sample_robots_rules(s: Site) -> DataFrame:
    targets = s.spark.createDataFrame([(u,) for u, _, _ in _JUDGED], "url string")
    return extract.robots_allowed(targets, _robots(s), "Bot").select("url", "allowed", "rule")


def _set(kind: str, entry: str, *locs: str) -> str:
    entries = "".join(f"<{entry}><loc> {loc.partition('@')[0]} </loc>{f'<lastmod>{loc.partition("@")[2]}</lastmod>' if '@' in loc else ''}</{entry}>" for loc in locs)
    return f'<?xml version="1.0"?><{kind} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{entries}</{kind}>'


_SITEMAPS = (
    ("https://a.example/index.xml", _set("sitemapindex", "sitemap", "https://a.example/s1.xml", "https://a.example/deep.xml", "https://a.example/gone.xml")),
    ("https://a.example/deep.xml", _set("sitemapindex", "sitemap", "https://a.example/s2.xml", "https://a.example/index.xml")),
    ("https://a.example/s1.xml", _set("urlset", "url", "https://a.example/1@2024-01-01", "https://a.example/2")),
    ("https://a.example/s2.xml", _set("urlset", "url", "https://a.example/2@2024-02-02", "https://a.example/3")),
    ("https://a.example/unnamed.xml", _set("urlset", "url", "https://a.example/4")),
    ("https://a.example/other.xml", "<urlset><url><loc>broken"),
)


@query("sample_sitemap_entries", values((("https://a.example/s1.xml", "urlset", "https://a.example/1", "2024-01-01"), ("https://a.example/s1.xml", "urlset", "https://a.example/2", "")), "url", "kind", "loc", "lastmod"))
def sample_sitemap_entries(s: Site) -> DataFrame:
    rows = s.spark.createDataFrame([_SITEMAPS[2], _SITEMAPS[5]], "url string, xml string")
    return tables.sitemap_entries(rows)


@query("sample_sitemaps", values((("https://a.example/1", "2024-01-01"), ("https://a.example/2", "2024-02-02"), ("https://a.example/3", "")), "loc", "lastmod"))
def sample_sitemaps(s: Site) -> DataFrame:
    """All that the sitemaps of a robots file list, through indexes that name one another."""
    documents = s.spark.createDataFrame(_SITEMAPS, "url string, xml string")
    return tables.expand_sitemaps(documents, tables.robots_sitemaps(_robots(s)).select(F.col("sitemap").alias("url")))


# By name, from SQL


@query("sql_table_function", values((*((1, f"https://shop.example/{p}".rstrip("/"), t) for p, t in _SHOP_EDGES), (1, *_BEYOND[0]), (2, *_BEYOND[1])), "page", "to_url", "link_text"))
def sql_table_function(s: Site) -> DataFrame:
    surface.register(s.spark)
    return s.spark.sql("SELECT page, to_url, link_text FROM {pages} p, LATERAL page_edges(p.url, p.html)", pages=captures(s.spark))


_SLUGS = (("My Project!", "my-project"), ("  --a  b--", "a-b"), ("é", ""), ("x" * 70, "x" * 60), ("A_b-C", "a-b-c"))


_SAMPLED = ((0, "https://shop.example/p/kettle"), (1, "https://shop.example/one"), (2, "https://shop.example/two"), (3, "https://shop.example"), (4, "https://shop.example/cookies?x"), (5, "https://shop.example/tag/steel"))


_SPACED = ((30, 2.0), (60, 1.0), (0, 60.0), (-4, 60.0), (1, 60.0))


_TARGETS = (
    ("https://a.example/", None),
    ("", "empty URL"),
    ("ftp://a.example/", "unsupported scheme 'ftp'"),
    ("//a.example/", "unsupported scheme ''"),
    ("https:///x", "missing host"),
    ("http://8.8.8.8/", None),
    ("http://127.0.0.1:80/", "blocked address 127.0.0.1"),
    ("http://10.1.2.3/", "blocked address 10.1.2.3"),
    ("http://172.31.0.1/", "blocked address 172.31.0.1"),
    ("http://172.32.0.1/", None),
    ("http://192.168.1.1./", "blocked address 192.168.1.1"),
    ("http://169.254.169.254/", "blocked address 169.254.169.254"),
    ("http://224.0.0.1/", "blocked address 224.0.0.1"),
    ("http://255.255.255.255/", "blocked address 255.255.255.255"),
    ("http://203.0.113.9/", "blocked address 203.0.113.9"),
    ("http://[::1]/", "blocked address ::1"),
    ("http://[fe80::1]/", "blocked address fe80::1"),
    ("http://[fd00::1]/", "blocked address fd00::1"),
    ("http://[2001:db8::1]/", "blocked address 2001:db8::1"),
    ("http://[2606:4700::1111]/", None),
    ("http://1.2.3/", None),
)


_BODIES = (("a" * 10, "b" * 20, "b"), ("a" * 10, "b" * 5, "a"), ("a" * 2_000, "b" * 5_000, "a"), (" " * 3_000 + "a", "b" * 9, "b"), ("a", None, "a"), ("", "b" * 9, ""))


# What is fetched, and when

_TYPES = (("text/html; charset=utf-8", True), ("TEXT/HTML", True), ("application/xhtml+xml", True), ("", True), ("application/pdf", False), ("image/svg+xml", False))


@query("content_hash_object", values((("https://a.example/", "h1"), ("https://b.example/é", "h2")), "url", "hash"))
def content_hash_object(s: Site) -> DataFrame:
    """A file that is one JSON object; a run without one has no hashes."""
    folder = written(s)
    folder.write(json.dumps({"https://a.example/": "h1", "https://b.example/é": "h2"}, ensure_ascii=False), RUNS[0], "_content_hashes.json")
    return folder.load_hashes(RUNS[0]).union(folder.load_hashes(RUNS[1]))


@query("state_file", values((("running", 7, "https://a.example/é", 2),), "status", "pages", "next", "depth"))
def state_file(s: Site) -> DataFrame:
    folder = written(s)
    folder.save_state(RUNS[0], status="running", pages_crawled=7, assets_from_pages=1, queue=[["https://a.example/é", "seed", 2]], started_at="2024-01-01 00:00:00")
    state = folder.load_state(RUNS[0])
    assert folder.load_state(RUNS[1]) is None
    return s.spark.createDataFrame([(state["status"], state["pages_crawled"], state["queue"][0][0], state["queue"][0][2])], "status string, pages int, next string, depth int")


@query("probably_html", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {str(x).upper()})" for t, x in _TYPES) + ") v(content_type, is_html)")
def probably_html(s: Site) -> DataFrame:
    rows = s.spark.createDataFrame([(t,) for t, _ in _TYPES], "content_type string")
    return rows.select("content_type", fetching.probably_html("content_type").alias("is_html"))


@query("chosen_html", values(((i, x[2]) for i, x in enumerate(_BODIES)), "n", "first"))
def chosen_html(s: Site) -> DataFrame:
    rows = s.spark.createDataFrame([(i, *x[:2]) for i, x in enumerate(_BODIES)], "n int, html string, rendered string")
    return rows.select("n", F.substring(F.trim(fetching.chosen_html("html", "rendered")), 1, 1).alias("first"))


@query("blocked_targets", values(_TARGETS, "url", "reason"))
def blocked_targets(s: Site) -> DataFrame:
    return s.spark.createDataFrame([(u,) for u, _ in _TARGETS], "url string").select("url", fetching.blocked("url").alias("reason"))


@query("request_spacing", f"SELECT per_minute, CAST(seconds AS DOUBLE) AS seconds FROM ({values(_SPACED, 'per_minute', 'seconds')})")
def request_spacing(s: Site) -> DataFrame:
    return s.spark.createDataFrame([(n,) for n, _ in _SPACED], "per_minute int").select("per_minute", fetching.spacing(F.col("per_minute")).alias("seconds"))


@query("sampled_links", values(_SAMPLED, "place", "url"))
def sampled_links(s: Site) -> DataFrame:
    parsed = extract.parse(captures(s.spark).where("page = 1").select("url", "html"), "edges")
    return fetching.sample_links(parsed, 6).select("place", "url")


@query("slugs", values(_SLUGS, "name", "slug"))
def slugs(s: Site) -> DataFrame:
    return s.spark.createDataFrame([(n,) for n, _ in _SLUGS], "name string").select("name", slug("name").alias("slug"))
