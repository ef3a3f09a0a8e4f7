from gleanery.operators import extract
from gleanery.operators.html import Page

BASIC = """<!DOCTYPE html><html lang="en-GB"><head><title> A  page </title><meta name="viewport" content="w"><meta name="Description" content="About it">
<meta property="og:type" content="article"><meta name="generator" content="WordPress 6.4"><meta name="robots" content="noindex, follow"><link rel="canonical" href="/x/"><link rel="alternate" hreflang="de" href="/de/">
<link rel="alternate" type="application/rss+xml" href="/feed"><link rel="next" href="?p=2">
<script type="application/ld+json">{"@context": "x", "@graph": [{"@type": "Product", "offers": {"price": 9.5, "priceCurrency": "EUR", "availability": "https://schema.org/InStock"}, "aggregateRating": {"ratingValue": "4.5", "reviewCount": 12}},
{"@type": ["Article", "article"], "datePublished": "2024-01-02", "author": [{"name": "Ann"}], "keywords": "a, B,a"}]}</script><script type="application/ld+json">{broken</script></head>
<body><nav><a href="/one">One</a><a href="/one">Again</a><a href="https://b.org/">B</a></nav><h1>Head</h1><h3>Jump</h3><h2></h2><!-- unseen -->
<p>first<p>second <b>bold</b><img src="/a.png" alt=""><img src="b.jpg"><a href="tel:+44 20 1">Call</a><a href="/privacy-policy">here</a><a href="/doc.pdf">Doc</a><a href="#top">Top</a>
<form><label for="q">Q</label><input id="q" type="text" autocomplete="on"><input type="email"><button></button></form><table><tr><td>1</td></tr></table>
<div id="d" itemscope itemtype="https://schema.org/Event/"><span id="d" itemscope itemtype="https://schema.org/Place"></span></div><noscript>no</noscript><style>p{}</style></body></html>"""


def test_basic_page():
    r = Page(BASIC, "https://a.com/dir/p").row()
    want = {
        "title": "A  page",
        "meta_description": "About it",
        "lang": "en-GB",
        "canonical_url": "https://a.com/x",
        "og_type": "article",
        "cms_generator": "WordPress 6.4",
        "robots_directives": "meta:noindex, follow",
        "hreflang_links": "de=https://a.com/de/",
        "feed_urls": "https://a.com/feed",
        "pagination_next": "https://a.com/dir/p?p=2",
        "json_ld_types": "Product|Article",
        "microdata_types": "Event/",
        "author": "Ann",
        "date_published": "2024-01-02",
        "schema_price": "9.5",
        "schema_currency": "EUR",
        "schema_availability": "InStock",
        "schema_rating": "4.5",
        "schema_review_count": "12",
        "tags_all": "a, B,a",
        "h1_joined": "Head",
        "heading_outline": "H3:Jump",
        "img_count": "2",
        "img_missing_alt_count": "2",
        "nav_link_count": "2",
        "link_count_internal": "4",
        "link_count_external": "2",
        "privacy_policy_url": "https://a.com/privacy-policy",
        "has_viewport_meta": "1",
        "wcag_lang_valid": "1",
        "wcag_heading_order_valid": "0",
        "wcag_img_alt_pct": "0.0",
        "wcag_form_labels_pct": "0.5",
        "wcag_autocomplete_pct": "0.5",
        "wcag_empty_headings": "1",
        "wcag_duplicate_ids": "1",
        "wcag_empty_buttons": "1",
        "wcag_tables_no_headers": "1",
        "wcag_has_nav": "1",
        "wcag_has_search": "0",
    }
    assert {k: r[k] for k in want} == want
    assert "unseen" not in r["visible_text"] and "no" not in r["visible_text"].split() and "second bold" in r["visible_text"]


def test_hostile_pages():
    for html in ('<script type="application/ld+json">' + "[" * 100_000 + "</script>", '<script type="application/ld+json">{"@type": 3, "author": 7, "offers": 1, "itemListElement": 1, "@graph": {}}</script>', '<script type="application/ld+json">{"@type": ["BreadcrumbList"], "itemListElement": [{"position": "x"}, 4]}</script>', None, "", "<", "<p", "</div></p>", "<a href='http://[bad'>x</a>", "<!", "<script>never ends", "<b>" * 5000 + "deep", "&#xFFFFFFF;", "<![CDATA[x]]>", "\0"):
        row = Page(html, "https://a.com/").row()
        assert set(row) == set(extract.FIELDS)
    assert Page("<p>x", None).row()["word_count"] == "1"


def test_whole_pages_are_searched():
    late = "<p>x</p>" * 60_000 + '<p>Last updated: 1 May 2024</p><link rel="alternate" hreflang="en" href="/' + "long" * 10_000 + '">'
    row = Page(late, "https://a.com/").row()
    assert row["visible_dates"] == "1 May 2024" and len(row["hreflang_links"]) > 40_000
    many = "".join(f'<link rel="alternate" hreflang="l{i}" href="/{i}">' for i in range(30))
    assert len(Page(many, "https://a.com/").row()["hreflang_links"].split("|")) == 20


def test_only_what_is_asked_for(spark):
    df = spark.createDataFrame([(1, "https://a.com/", BASIC)], "id long, url string, html string")
    assert extract.parse(df, "tags").columns == ["id", "url", "tags"]
    assert extract.parse(df, "edges", "nav").columns == ["id", "url", "edges", "nav"]


def test_frames(spark):
    captures = spark.createDataFrame([(1, "https://a.com/dir/p", BASIC), (2, "https://a.com/empty", None)], "id long, url string, html string")
    parsed = extract.parse(captures).cache()
    rows = {r.id: r for r in extract.page_rows(parsed).collect()}
    assert rows[1].domain == "a.com" and rows[1].content_kind_guess == "product" and rows[2].word_count == "0"
    assert len(rows[1].content_hash) == 16
    assert sorted(r.to_url for r in extract.edges(parsed).collect()) == ["https://a.com/doc.pdf", "https://a.com/one", "https://a.com/one", "https://a.com/privacy-policy", "https://b.org"]
    assert sorted((r.nav_href, r.nav_text) for r in extract.nav_links(parsed).collect()) == [("https://a.com/one", "One"), ("https://b.org", "B")]
    assert [(r.raw_href, r.phone_number) for r in extract.phones(parsed).collect()] == [("tel:+44 20 1", "+44 20 1")]
    assert sorted(r.tag_value for r in extract.tags(parsed).collect()) == ["a, B,a"]
    assert sorted((r.asset_url, r.category) for r in extract.assets(parsed).collect()) == [("https://a.com/a.png", "image"), ("https://a.com/dir/b.jpg", "image"), ("https://a.com/doc.pdf", "pdf")]


def test_signals_and_dates(spark):
    html = """<html><body class="x y" data-app="1"><p>Last updated: 9 May 2023</p><span class="post-date">June 3, 2024</span><meta name="a" content="1"><meta property="og:title" content="t"><time datetime="2024-01-01">then</time></body></html>"""
    page = Page(html, "https://a.com/", {"server": "nginx", "X-Other": "no", "VIA": "proxy"})
    assert page.row()["visible_dates"] == "9 May 2023|June 3, 2024"
    got = page.signals()
    assert got["meta_names"] == "a" and got["og_properties"] == "og:title" and got["headers"] == "Server=nginx|Via=proxy"
    assert got["data_attributes"] == "data-app" and got["body_classes"] == "x y" and got["times"] == "2024-01-01" and got["has_json_ld"] == "0"
    df = spark.createDataFrame([("https://a.com/", html, {"Server": "s"})], "url string, html string, h map<string,string>")
    assert extract.signals(df, headers="h").first().headers == "Server=s"


def test_robots(spark):
    targets = spark.createDataFrame([("https://a.com/x",), ("https://a.com/private/y",), ("https://a.com/private/deep/z",), ("https://b.com/private/",)], "url string")
    robots = spark.createDataFrame([("https://a.com", "User-agent: *\nDisallow: /private/\nDisallow: /private/deep/\n")], "origin string, txt string")
    got = {r.url: (r.allowed, r.rule) for r in extract.robots_allowed(targets, robots, "Bot").collect()}
    assert got == {"https://a.com/x": (True, ""), "https://a.com/private/y": (False, "/private/"), "https://a.com/private/deep/z": (False, "/private/deep/"), "https://b.com/private/": (True, "")}
