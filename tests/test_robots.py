"""Robots rules against the standard library's parser, and sitemaps against its XML parser."""

import random
from urllib.robotparser import RobotFileParser

from gleanery.operators import extract
from gleanery.sources import tables

LINES = ("User-agent: *", "User-agent: Gleaner", "user-agent: other", "User-agent: glean", "Disallow: /a", "Disallow: /a/b", "Allow: /a/b/c", "Disallow:", "Allow:", "Disallow: /%61/x y", "", "", " ", "# comment", "Disallow: /b # why", "Crawl-delay: 3", "Sitemap: https://x.example/s.xml", "nonsense", "Disallow: /q?x=1", "Disallow: *", "Allow: /")
PATHS = ("", "/", "/a", "/a/", "/a/b", "/a/b/c/d", "/b", "/q?x=1&y", "/%61/x%20y", "/c+d", "/%zz")


def test_rules(spark):
    rng = random.Random(7)
    robots = [(f"https://h{i}.example", rng.choice(["\n", "\r\n"]).join(rng.choice(LINES) for _ in range(rng.randint(0, 14)))) for i in range(150)]
    robots += [("https://none.example", None)]
    targets = [(f"{o}{p}",) for o, _ in [*robots, ("https://unknown.example", None)] for p in PATHS]
    df = spark.createDataFrame(targets, "url string"), spark.createDataFrame(robots, "origin string, txt string")
    for agent in ("Gleaner/2.0", "Nobody"):
        got = {r.url: (r.allowed, r.rule) for r in extract.robots_allowed(*df, agent).collect()}
        assert len(got) == len(targets)
        known = dict(robots)
        for (link,) in targets:
            parser = RobotFileParser()
            origin = link[: link.index("/", 8)] if "/" in link[8:] else link
            parser.parse((known.get(origin) or "").splitlines())
            allowed, rule = got[link]
            assert allowed == parser.can_fetch(agent, link), (known.get(origin), link)
            assert bool(rule) != allowed
    assert not any(w in extract.robots_allowed(*df, "x")._jdf.queryExecution().toString() for w in ("Python", "Pandas", "Arrow"))


def test_sitemaps(spark):
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<!-- made -->'
    rows = [
        ("a", f'{head}<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://x.example/1?a=1&amp;b=2 </loc><lastmod>2024-01-01</lastmod><priority>1</priority></url><url><lastmod>2024</lastmod></url><url><loc><![CDATA[https://x.example/2]]></loc></url></urlset>'),
        ("b", f'{head}<s:sitemapindex xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9"><s:sitemap><s:loc>https://x.example/s.xml</s:loc></s:sitemap></s:sitemapindex>'),
        ("c", "<urlset><url><loc>https://x.example/broken</loc></url>"),
        ("d", "<urlset><url><loc>broken"),
        ("e", None),
        ("f", "no xml"),
        ("g", "<urlset></urlset>"),
        ("h", "<html><url><loc>https://x.example/3</loc></url></html>"),
        ("i", '<urlset xmlns:image="i"><url><loc>https://x.example/4</loc><image:image><image:loc>https://x.example/i.png</image:loc></image:image></url></urlset>'),
    ]
    df = tables.sitemap_entries(spark.createDataFrame(rows, "url string, xml string"))
    got = sorted(map(tuple, df.collect()))
    assert got == [("a", "urlset", "https://x.example/1?a=1&b=2", "2024-01-01"), ("a", "urlset", "https://x.example/2", ""), ("b", "index", "https://x.example/s.xml", ""), ("i", "urlset", "https://x.example/4", "")]
    assert not any(w in df._jdf.queryExecution().toString() for w in ("Python", "Pandas", "Arrow"))
