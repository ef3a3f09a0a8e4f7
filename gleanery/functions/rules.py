"""Ordered rules: the first that holds decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions import urls
from gleanery.functions.scalars import rounded, text

# A path that holds the token gives the label, once for each token.
PATH_HINTS = (
    ("/blog", "blog_path"),
    ("/blogs/", "blog_path"),
    ("/news", "news_path"),
    ("/newsroom", "news_path"),
    ("/publication", "publication_path"),
    ("/publications", "publication_path"),
    ("/gp/", "gp_path"),
    ("/service", "service_path"),
    ("/services/", "service_path"),
    ("/about", "about_path"),
    ("/contact", "contact_path"),
    ("/jobs", "jobs_path"),
    ("/careers", "careers_path"),
    ("/events", "events_path"),
    ("/event/", "events_path"),
    ("/patients", "patients_path"),
    ("/patient-", "patients_path"),
    ("/explore-roles", "careers_path"),
    ("/working-health", "careers_path"),
    ("/training", "training_path"),
    ("/guidance", "guidance_path"),
    ("/statistics", "statistics_path"),
    ("/products/", "product_path"),
    ("/product/", "product_path"),
    ("/shop/", "product_path"),
    ("/collections/", "product_path"),
    ("/recipe", "recipe_path"),
    ("/recipes/", "recipe_path"),
    ("/faq", "faq_path"),
    ("/help/", "help_path"),
    ("/support/", "help_path"),
    ("/forum", "forum_path"),
    ("/community/", "forum_path"),
    ("/wiki/", "wiki_path"),
    ("/docs/", "docs_path"),
    ("/documentation/", "docs_path"),
    ("/portfolio/", "portfolio_path"),
    ("/case-stud", "case_study_path"),
    ("/review", "review_path"),
    ("/testimonial", "review_path"),
    ("/pricing", "pricing_path"),
    ("/plans/", "pricing_path"),
    ("/team/", "team_path"),
    ("/staff/", "team_path"),
    ("/people/", "team_path"),
    ("/press/", "press_path"),
    ("/media/", "press_path"),
    ("/legal/", "legal_path"),
    ("/terms", "legal_path"),
    ("/privacy", "legal_path"),
    ("/policy/", "legal_path"),
    ("/signin", "auth_path"),
    ("/login", "auth_path"),
    ("/register", "auth_path"),
    ("/signup", "auth_path"),
    ("/account/", "auth_path"),
    ("/search", "search_path"),
)

# Fixed values: (schema type, path hint, kind); either of the two suffices.
TYPE_OR_HINT_KINDS = (
    ("blogposting", "blog_path", "blog"),
    ("newsarticle", "news_path", "news"),
    ("product", "product_path", "product"),
    ("jobposting", "jobs_path", "job_posting"),
    ("recipe", "recipe_path", "recipe"),
    ("howto", "", "how_to"),
    ("course", "training_path", "course"),
    ("qapage", "forum_path", "qa"),
    ("videoobject", "", "video"),
    ("softwareapplication", "", "software"),
    ("review", "review_path", "review"),
    ("faqpage", "faq_path", "faq"),
)
HINT_KINDS = (
    ("contact_path", "contact"),
    ("about_path", "about"),
    ("pricing_path", "pricing"),
    ("case_study_path", "case_study"),
    ("docs_path", "documentation"),
    ("legal_path", "legal"),
    ("search_path", "search"),
)
BREADCRUMB_KINDS = (
    (("blog", "blogs"), "blog"),
    (("news", "newsroom"), "news"),
    (("publication", "publications"), "publication"),
    (("event", "events"), "event"),
    (("about",), "about"),
    (("contact", "get in touch"), "contact"),
    (("service", "services"), "service"),
)
BODY_CLASS_KINDS = (
    ("homepage", "homepage"),
    ("aboutoverviewpage", "about"),
    ("newsitemlistingpage", "news"),
    ("newsitempage", "news"),
    ("contactpage", "contact"),
    ("eventpage", "event"),
    ("resourcepage", "resource"),
    ("staffpage", "staff"),
    ("blogentry", "blog"),
)

# Parts of referrers' hosts, of addresses worth less, and of stop words.
SOCIAL_HOSTS = ("facebook.", "fb.com", "twitter.", "t.co", "linkedin.", "instagram.", "youtube.", "youtu.be", "tiktok.", "pinterest.", "reddit.", "snapchat.")
SEARCH_HOSTS = ("google.", "bing.com", "duckduckgo.", "yahoo.", "baidu.", "yandex.", "ecosia.", "startpage.")
LOW_VALUE_PATHS = ("/tag/", "/tags/", "/page/", "/wp-content/", "/wp-includes/", "/feed/", "/author/", "/attachment/", "/trackback/", "/comment-page-", "/?replytocom=", "/print/")
STOP_WORDS = ("the", "and", "for", "with", "from", "this", "that", "your", "our", "are", "was", "has", "have", "been", "will", "can", "all", "not", "but", "you", "more", "page", "home", "site", "www", "com")


# Signs of analytics in HTML, and of training in titles and addresses.
ANALYTICS = ("googletagmanager.com", "google-analytics.com", "gtag/js", "dataLayer", "analytics.js", "ga.js")
TRAINING = ("training", "course", "courses", "learning", "cpd", "workshop", "webinar", "event", "events", "conference", "seminar", "masterclass")

# What a page's generator, body and response headers show of its system.
GENERATOR_MARKERS = (
    ("WordPress", ("wordpress", "developer starter kit")),
    ("Drupal", ("drupal",)),
    ("Joomla", ("joomla",)),
    ("SilverStripe", ("silverstripe",)),
    ("Concrete5", ("concrete5", "concrete cms")),
    ("TYPO3", ("typo3",)),
)
BODY_MARKERS = (
    ("WordPress", ("wp-content", "wp-includes", "wp-block-", "wp-json")),
    ("Drupal", ("drupal", "/sites/default/files/", "views-row", "drupal.js")),
    ("SharePoint", ("sharepoint", "s4-workspace", "ms-webpart", "_layouts/", "/_catalogs/", "x-sharepointheealthscore")),
    ("Next.js", ("__next", "_next/static", "_next/data")),
    ("Gatsby", ("__gatsby", "gatsby-")),
)
POWER_MARKERS = (("ASP.NET", ("asp.net",)), ("Express/Node", ("express",)), ("PHP", ("php",)))
LATE_BODY_MARKERS = (
    ("SilverStripe", ("silverstripe", "themes/pgme")),
    ("Squarespace", ("squarespace",)),
    ("Wix", ("wix.com",)),
    ("Umbraco", ("umbraco",)),
    ("Sitecore", ("sitecore",)),
    ("Sitefinity", ("sitefinity",)),
    ("Kentico", ("kentico",)),
    ("Optimizely", ("episerver", "optimizely")),
    ("Contensis", ("contensis",)),
)


def first_of(cases: list[tuple[Column, Column | str]], otherwise: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    out = F.when(cases[0][0], lit(cases[0][1]))
    for test, value in cases[1:]:
        out = out.when(test, lit(value))
    return out.otherwise(lit(otherwise))


def any_in(c: Column, tokens) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(t)) for t in tokens))


def path_hints(url) -> Column:
    low = F.lower(urls.path(url))
    return F.concat_ws("|", *(F.when(F.contains(low, F.lit(token)), F.lit(label)) for token, label in PATH_HINTS))


def content_kind(hints: Column, types: Column, og_type: Column, path: Column, breadcrumb: Column, body_classes: Column) -> Column:
    types, og, path, crumb, body = (F.lower(text(c)) for c in (types, og_type, path, breadcrumb, body_classes))
    has = lambda c, t: F.contains(c, F.lit(t))
    cases: list[tuple[Column, Column | str]] = [(has(types, t) | has(hints, h) if h else has(types, t), kind) for t, h, kind in TYPE_OR_HINT_KINDS]
    cases += [
        (has(types, "article") & ~has(path, "blog"), "article"),
        (has(types, "event") & has(hints, "events_path"), "event"),
        (any_in(types, ("localbusiness", "restaurant")), "local_business"),
        (has(types, "webpage") | og.isin("website", "article"), "webpage"),
        (any_in(types, ("medicalbusiness",)), "medical_page"),
        (any_in(types, ("collectionpage", "itemlist")), "listing"),
        *((has(hints, h), kind) for h, kind in HINT_KINDS),
        *((any_in(crumb, tokens), kind) for tokens, kind in BREADCRUMB_KINDS),
        (any_in(body, ("single-post", "post-template")), "blog"),
        (any_in(body, ("page-template", "page-id")), "webpage"),
        (has(body, "archive"), "listing"),
        *((has(body, t), kind) for t, kind in BODY_CLASS_KINDS),
    ]
    node = F.regexp_extract(body, r"page-node-type-(\S+)", 1)
    cases += [
        (any_in(node, ("article", "blog")), "blog"),
        (has(node, "news"), "news"),
        (has(node, "event"), "event"),
        (any_in(node, ("page", "section")), "webpage"),
        (path.isin("/", ""), "homepage"),
    ]
    return first_of(cases, "unknown")


def referrer_bucket(referrer, domain) -> Column:
    ref, dom = F.trim(text(referrer)), F.lower(F.trim(text(domain)))
    low, name = F.lower(ref), urls.host(ref)
    dotted = F.concat(name, F.lit("."))
    return first_of(
        [
            (ref == "", "unknown"),
            (low == "seed", "direct_seed"),
            (low.startswith("sitemap:"), "sitemap"),
            (name == "", "other"),
            ((name == dom) | F.endswith(name, F.concat(F.lit("."), dom)), "internal_discovery"),
            (any_in(dotted, SOCIAL_HOSTS) | name.isin(*(h.rstrip(".") for h in SOCIAL_HOSTS)), "social_referrer"),
            (any_in(dotted, SEARCH_HOSTS), "search_referrer"),
        ],
        "external_other",
    )


def failure_class(message, error_type) -> Column:
    m, t = F.lower(text(message)), text(error_type)
    return first_of(
        [
            (t != "fetch_failed", F.when(t == "", F.lit("unknown")).otherwise(t)),
            (F.contains(m, F.lit("timeout")), "timeout"),
            (any_in(m, ("connectionerror", "connection refused")), "connection"),
            (any_in(m, ("ssl", "certificate")), "ssl"),
            (F.contains(m, F.lit("blocked:")), "blocked_private"),
            (F.contains(m, F.lit("redirect limit")), "redirect_limit"),
            (m.startswith("http "), "http_error"),
        ],
        "fetch_failed",
    )


def status_of_message(message) -> Column:
    """The status that a message such as `HTTP 404` names; rows of failed fetches hold 0 in their status cell."""
    found = F.regexp_extract(F.lower(text(message)), "^http ([0-9]{3})", 1)
    return F.when(found != "", found.cast("int"))


def priority(url, depth: Column, seed: Column) -> Column:
    """Lower goes first."""
    p = F.regexp_replace(F.lower(urls.path(url)), "/+$", "")
    return depth * 10.0 - F.when(seed, 100.0).otherwise(0.0) - F.when(p == "", 5.0).otherwise(0.0) + F.when(any_in(p, LOW_VALUE_PATHS), 20.0).otherwise(0.0)


def noindex_sources(robots) -> tuple[Column, Column]:
    """By meta, by header; a directive without either prefix counts as meta."""
    found = F.filter(F.transform(F.split(F.lower(text(robots)), "[|]"), lambda x: F.trim(x)), lambda s: F.contains(s, F.lit("noindex")))
    header = F.exists(found, lambda s: s.startswith("header:"))
    return F.exists(found, lambda s: ~s.startswith("header:")), header


#: Suffixes below which names are registered; a list of one's own can be given.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "nhs.uk", "com.au", "co.nz", "co.jp")


def ownership(domain, rules=(), suffixes=SUFFIXES) -> Column:
    """The first rule whose suffix ends the name, else the registered domain. Public suffixes are approximated: those
    given, and else the last label."""
    d = F.lower(text(domain))
    labels = F.split(d, "[.]")
    long = reduce(lambda a, s: a | d.endswith(f".{s}"), suffixes, F.lit(False))
    keep = F.when(long, 3).otherwise(2)
    registered = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - keep + 1), keep), ".")
    return first_of([(d.endswith(s.lower()), label) for s, label in rules] + [(F.size(labels) <= keep, d)], registered)


def tech_stack(html, generator, powered_by, header_generator=None) -> Column:
    """The system a page runs on, by its generator, what its whole body holds, response headers, an almost empty root element,
    and what else its body holds."""
    body, gen, power, named = F.lower(text(html)), F.lower(text(generator)), F.lower(text(powered_by)), F.lower(text(F.lit(None) if header_generator is None else header_generator))
    # what an element of that id holds up to its end, where that isn't far
    root = r"(?s)<div\b(?=[^>]*\bid=[\"']?(?:root|app)[\"'\s>])[^>]*>(.{0,2000}?)</div"
    bare = F.length(F.regexp_replace(F.regexp_extract(body, root, 1), "<[^>]*>|\\s+", "")) < 50
    return first_of(
        [
            *((any_in(gen, marks), name) for name, marks in GENERATOR_MARKERS),
            *((any_in(body, marks), name) for name, marks in BODY_MARKERS),
            (F.contains(named, F.lit("drupal")), "Drupal"),
            *((any_in(power, marks), name) for name, marks in POWER_MARKERS),
            (body.rlike(root) & bare, "JS SPA"),
            *((any_in(body, marks), name) for name, marks in LATE_BODY_MARKERS),
        ],
        "static/unknown",
    )


def tokens_found(c, tokens) -> Column:
    """Those of the tokens that a cell holds, whatever the case, joined by pipes: analytics in HTML, topics in titles."""
    low = F.lower(text(c))
    return F.concat_ws("|", *(F.when(F.contains(low, F.lit(t.lower())), F.lit(t)) for t in tokens))


def run_status(status: Column, pages: Column) -> Column:
    """Of a run: without a state, or a new one, pages show that it was interrupted."""
    return F.when((status.isNull() | (status == "new")) & (pages > 0), F.lit("interrupted")).otherwise(F.coalesce(status, F.lit("new")))


def readability(visible) -> Column:
    """Flesch-Kincaid grade, null below 30 words. Syllables are approximated by runs of vowels, without a final silent e."""
    t = F.lower(text(visible))
    count = lambda pattern: F.size(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    words = F.size(F.filter(F.split(t, "\\s+"), lambda x: x != ""))
    sentences = F.greatest(F.lit(1), count("[.!?]+(?:\\s|$)"))
    syllables = F.greatest(words, count("[aeiouy]+") - count("[^aeiouyl]e\\b"))
    return F.when(words >= 30, rounded(0.39 * words / sentences + 11.8 * syllables / words - 15.59))
