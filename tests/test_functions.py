import random
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from gleanery.functions import rules, scalars, urls


def one(spark, column, **cells):
    df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells)) if cells else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("cell", "want"), [("12", 12), (" -3 ", -3), ("12.0", 0), ("1_000", 0), ("", 0), (None, 0), ("x", 0)])
def test_as_int(spark, cell, want):
    assert one(spark, scalars.as_int("c"), c=cell) == want


@pytest.mark.parametrize(("cell", "want"), [("1.5", 1.5), ("1d", 0.0), ("1.5f", 0.0), ("", 0.0), (None, 0.0), ("1e3", 1000.0)])
def test_as_float(spark, cell, want):
    assert one(spark, scalars.as_float("c"), c=cell) == want


@pytest.mark.parametrize(
    ("cell", "want"),
    [("2024-03-05T10:00:00+02:00", "2024-03-05"), ("Tue, 05 Mar 2024 10:00:00 GMT", "2024-03-05"), ("seen 2023-01-02.", "2023-01-02"), ("", None), ("March 2024", None), (None, None)],
)
def test_norm_date(spark, cell, want):
    assert one(spark, scalars.norm_date("c"), c=cell) == want


@pytest.mark.parametrize(("x", "want"), [(0.25, 0.2), (0.75, 0.8), (2.0, 2.0), (12.34, 12.3)])
def test_rounding_is_half_even(spark, x, want):
    assert spark.range(1).select(scalars.rounded(F.lit(x)).alias("x")).first().x == want


def test_lists_and_cells(spark):
    assert one(spark, scalars.parts("c"), c="a| b ||c ") == ["a", "b", "c"]
    assert one(spark, scalars.parts("c"), c="") == []
    assert one(spark, scalars.sanitised("c"), c="a\0b") == "ab"
    assert one(spark, F.length(scalars.sanitised("c")), c="x" * 40_000) == 32_000 + len("…[truncated]")
    assert one(spark, scalars.occurrences(F.col("c"), F.lit("aA")), c="aaaa AA") == 3


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://A.Example.com:8080/x", "a.example.com"),
        ("http://user:pw@host_1.org?q", "host_1.org"),
        ("//cdn.x/y", "cdn.x"),
        ("http://münchen.de/|a b", "münchen.de"),
        ("http://[::1]:80/", "::1"),
        ("/only/path", ""),
        ("", ""),
    ],
)
def test_host(spark, url, want):
    assert one(spark, urls.host("c"), c=url) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [("HTTP://A.com", "http://a.com/"), ("http://a.com/x/#f", "http://a.com/x"), (" https://A.com/B/?b=1&a=2 ", "https://a.com/B?b=1&a=2"), ("not a url", "not a url"), ("/x/", "/x/")],
)
def test_url_key(spark, url, want):
    assert one(spark, urls.url_key("c"), c=url) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://A.com:443/x/", "https://a.com/x"),
        ("https://a.com:80", "https://a.com"),
        ("http://a.com/?b=2&a=1#f", "https://a.com/?a=1&b=2"),
        ("http://a.com/x?q=a%20b&k=", "https://a.com/x?k=&q=a+b"),
        ("http://a.com/x?a=1&a=0", "https://a.com/x?a=0&a=1"),
        ("http://a.com/x?flag", "https://a.com/x?flag="),
    ],
)
def test_crawl_key(spark, url, want):
    assert one(spark, urls.crawl_key("c"), c=url) == want


def plain_crawl_key(url):
    """By the standard library."""
    s = urlsplit(url)
    name = s.netloc.lower()
    name = name[:-4] if name.endswith(":443") else name[:-3] if name.endswith(":80") else name
    whole = urlunsplit(("https" if s.scheme in ("http", "https") else s.scheme, name, s.path or "/", urlencode(sorted(parse_qsl(s.query, keep_blank_values=True))), ""))
    return whole.rstrip("/") or whole


def test_crawl_keys_equal_the_library_s(spark):
    rng = random.Random(9)
    some = ["".join(rng.choice(["http://", "https://", "HTTP://"]) + rng.choice(["a.com", "B.org:443", "u@c.net:80", "d.io:8080"]) + rng.choice(["", "/", "/x/", "/x/y;p=1", "//z//"])) + "?" * (i % 2) + "".join(rng.choice(["a=1", "&", "=", "b=%20", "%41", "%zz", "+", "é", "c=x=y", "~*", "%C3%A9", "/", ";"]) for _ in range(i % 7) if i % 2) + rng.choice(["", "#f", "#"]) for i in range(400)]
    got = spark.createDataFrame([(u,) for u in some], "u string").select("u", urls.crawl_key("u").alias("k")).collect()
    assert [(r.u, r.k) for r in got if r.k != plain_crawl_key(r.u)] == []
    plan = spark.createDataFrame([("x",)], "u string").select(urls.crawl_key("u"))._jdf.queryExecution().toString()
    assert "Python" not in plan.split("== Physical Plan ==")[1]


def test_links_and_assets(spark):
    assert one(spark, urls.link_norm(F.col("l"), F.col("b")), l="../y/#z", b="https://a.com/x/w") == "https://a.com/y"
    assert one(spark, urls.asset_category("c"), c="https://a.com/F.PDF?x=.js") == "pdf"
    assert one(spark, urls.asset_category("c"), c="https://a.com/page") is None


def test_scope(spark):
    rows = [("https://a.example.com/x",), ("https://example.com.evil.org/",), ("https://example.com/private",)]
    df = spark.createDataFrame(rows, "u string")
    assert [r.u for r in df.where(urls.in_scope("u", [".example.com"], without=["PRIVATE"])).collect()] == [rows[0][0]]


def test_hints_repeat_for_each_token(spark):
    assert one(spark, rules.path_hints("c"), c="https://a.com/newsroom") == "news_path|news_path"


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ({"types": "BlogPosting"}, "blog"),
        ({"types": "Article"}, "article"),
        ({"types": "MedicalWebPage"}, "webpage"),
        ({"og": "website", "hints": "contact_path"}, "webpage"),
        ({"hints": "contact_path"}, "contact"),
        ({"crumb": "Home > Get in touch"}, "contact"),
        ({"body": "page-node-type-news_item"}, "news"),
        ({"path": "/"}, "homepage"),
        ({"path": "/x"}, "unknown"),
    ],
)
def test_content_kind(spark, given, want):
    cell = {"hints": "", "types": "", "og": "", "path": "/x", "crumb": "", "body": "", **given}
    c = {k: F.col(k) for k in cell}
    assert one(spark, rules.content_kind(c["hints"], c["types"], c["og"], c["path"], c["crumb"], c["body"]), **cell) == want


@pytest.mark.parametrize(
    ("ref", "want"),
    [("", "unknown"), ("SEED", "direct_seed"), ("sitemap:x", "sitemap"), ("words", "other"), ("https://blog.a.com/", "internal_discovery"), ("https://t.co/x", "social_referrer"), ("https://www.microsoft.com/", "social_referrer"), ("https://www.bing.com/", "search_referrer"), ("https://b.com/", "external_other")],
)
def test_referrer_bucket(spark, ref, want):
    assert one(spark, rules.referrer_bucket("r", F.lit("a.com")), r=ref) == want


@pytest.mark.parametrize(("robots", "want"), [("meta:noindex", (True, False)), ("header: NoIndex, x", (False, True)), ("noindex|header:noindex", (True, True)), ("meta:index", (False, False)), ("", (False, False))])
def test_noindex(spark, robots, want):
    meta, header = rules.noindex_sources("r")
    assert (one(spark, meta, r=robots), one(spark, header, r=robots)) == want


def test_ownership_and_priority(spark):
    assert one(spark, rules.ownership("d"), d="a.b.nhs.uk") == "b.nhs.uk"
    assert one(spark, rules.ownership("d", [("example.org", "Us")]), d="notexample.org") == "Us"
    assert one(spark, rules.priority("u", F.lit(2), F.lit(False)), u="https://a.com/tag/x") == 40.0
    assert one(spark, rules.priority("u", F.lit(0), F.lit(True)), u="https://a.com/") == -105.0
    assert one(spark, rules.priority("u", F.lit(1), F.lit(False)), u="https://a.com/x/feed/") == 10.0
