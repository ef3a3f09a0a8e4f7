"""Links by patterns against the tree, and references against the standard library's resolution."""

import itertools
import random
from collections import Counter
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from gleanery.functions import urls
from gleanery.operators import links
from gleanery.operators.html import Page

BASES = ("https://a.example/b/c/d;p?q", "http://a.example", "https://a.example/", "https://a.example//b//c/", "https://a.example/b/../c/./d", "ftp://f.example/x/y", "mailto:a@b.example", "", "https://u:p@a.example:8080/x?y#z", "HTTPS://A.Example/B")
# the examples of RFC 3986, 5.4, and more
LINKS = ("g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "../../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y", "http:g", "https:g", "https://x.example/a/../b/", "//x.example", "//x.example/a//b", "a//b", "/a//b/", "a\tb", "HTTPS://X.example/q", "mailto:x@y.example", "tel:1", "data:,x", "https://[::1]/x", "//[::1", "x?a=/../b", "é/ü", "g?", "/", "///g", "..//g", "g//", "?", "file:///x", "javascript:void(0)")


def wanted(link, base):
    try:
        return urljoin(base, link)
    except ValueError:
        return ""


def test_references(spark):
    pairs = list(itertools.product(LINKS, BASES))
    rng = random.Random(3)
    pieces = ["a", "..", ".", "/", "//", "b", "?", "q=1", "#", "f", ";p"]
    pairs += [("".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))), rng.choice(BASES)) for _ in range(1500)]
    pairs = list(dict.fromkeys(pairs))
    got = spark.createDataFrame(pairs, "link string, base string").select("link", "base", urls.resolved(F.col("link"), F.col("base")).alias("to")).collect()
    # an empty query or fragment has no form of its own
    wrong = [(r.link, r.base, r.to, w) for r in got if r.to.replace("?#", "#").rstrip("#?") != (w := wanted(r.link, r.base)).replace("?#", "#").rstrip("#?")]
    assert len(got) == len(pairs) and not wrong, wrong[:20]


PAGE = """<html><body><nav class="a>b"><a href="/one/">One</a><a href=/two>Two &amp; <b>more</b></a><a href='/one/'> Again </a><a name="x">no</a></nav>
<!-- <a href="/hidden">x</a> --><script>var a = '<a href="/no">';</script><div role="navigation"><A HREF="/three/">Th&eacute; &#233; &#xe9; &nosuch; &</A></div>
<p><a title="a>b" href="../up?x=1&amp;y=2#f">Up</a><a href="tel:1">t</a><a href="mailto:x">m</a><a href="#top">top</a><a href=" https://b.example/x/ ">B</a><a href="">e</a><area href="/area"><abbr href="/abbr">n</abbr></p>
<style>a{}</style><a href="//c.example"><img src="/i.png" alt="i"></a><a data-href="/data" href="/real">r</a></body></html>"""


def test_links_are_the_tree_s(spark):
    rows = [(1, "https://a.example/x/y", PAGE), (2, "https://a.example", None), (3, None, PAGE), (4, "https://a.example/q", "<a href=x")]
    df = spark.createDataFrame(rows, "n int, url string, html string")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").selectExpr("cast(100 + page_id as int) AS n", "url", "html")
    df = df.unionByName(pages)
    trees = {r.n: Page(r.html, r.url) for r in df.collect()}
    edges = Counter((r.from_url or "", r.to_url, r.link_text) for r in links.edges(df).collect())
    assert edges == Counter((p.url, *e) for p in trees.values() for e in p.edges())
    nav = Counter((r.page_url or "", r.nav_href, r.nav_text) for r in links.nav_links(df).collect())
    assert nav == Counter((p.url, *e) for p in trees.values() for e in p.nav_links())


@pytest.mark.parametrize("find", [links.edges, links.nav_links])
def test_no_python(spark, find):
    df = find(spark.createDataFrame([("https://a.example", PAGE)], "url string, html string"))
    assert not any(w in df._jdf.queryExecution().toString() for w in ("Python", "Arrow", "Pandas", "Exchange"))
