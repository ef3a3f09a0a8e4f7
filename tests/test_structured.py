"""JSON-LD by VARIANT against the tree's reading of it."""

from pyspark.sql import functions as F

from gleanery.operators import jsonld
from gleanery.operators.html import Page
from tests.pages import PAGES

DEEP = """<script type="application/ld+json">[[{"@type":"A"}],{"@graph":[{"@graph":[{"@type":["B","a"]},[{"@type":"C"}]]}]}]</script>
<!-- <script type="application/ld+json">{"@type":"No"}</script> --><script>var x = "<script type=\\"application/ld+json\\">{}";</script>
<SCRIPT TYPE='application/ld+json' id=1>{"@type":"D","keywords":[1," two ","TWO"],"offers":{"lowPrice":3}}</SCRIPT><script type="application/ld+json"> </script>"""
NEST = '<script type="application/ld+json">' + '{"@graph":[' * 12 + '{"@type":"Inner","@id":"x"}' + "]}" * 12 + "</script>"
PLAIN = '<script type="application/ld+json">7</script><script type="application/ld+json">["a", null, {"author": ["Ann", {"name": " "}, {"name": "Bo"}]}]</script>'
OFFERS = '<script type="application/ld+json">[{"@type":"Product","offers":{"priceCurrency":"EUR"}},{"@type":"product","offers":[]},{"@type":"Product","offers":{"priceCurrency":"GBP","availability":"x/y/Z"}},{"review":{"reviewCount":2}},{"review":{"ratingValue":5}},{"aggregateRating":{"ratingValue":1}}]</script>'


def test_cells_are_the_tree_s(spark):
    rows = [(n, u, h) for n, u, h, _ in PAGES] + [(100 + i, "https://a.example/", h) for i, h in enumerate((DEEP, NEST, PLAIN, OFFERS, "", "<script type='application/ld+json'>"))]
    df = spark.createDataFrame(rows, "n int, url string, html string")
    for r in jsonld.cells(df.drop("url")).collect():
        page = Page(next(h for n, _, h in rows if n == r.n), "https://a.example/")
        words, sections = page.keywords()
        want = {"json_ld_types": "|".join(page.types()), "json_ld_keywords": "|".join(words), "json_ld_sections": "|".join(sections), "breadcrumb_schema": page.breadcrumb_names(), **page.schema()}
        assert {k: r[k] for k in want} == want, r.n
        assert r.json_ld_id == next((str(x["@id"]) for x in page.data if x.get("@id")), "")


def test_people(spark):
    df = spark.createDataFrame([(1, PLAIN)], "n int, html string")
    r = jsonld.cells(df).first()
    assert r.author == "Ann | Bo" and r.publisher == ""


def test_no_python_and_no_shuffle(spark):
    df = jsonld.cells(spark.createDataFrame([(1, DEEP)], "n int, html string"))
    assert not any(w in df._jdf.queryExecution().toString() for w in ("Python", "Arrow", "Exchange", "Generate"))


def test_levels_are_enough(spark):
    """However deep graphs and lists lie in one another."""
    for depth in (1, 5, 30):
        text = '{"@graph":[[' * depth + '{"@type":"X"}' + "]]}" * depth
        df = spark.createDataFrame([(f'<script type="application/ld+json">{text}</script>',)], "html string")
        assert [r.json_ld_types for r in jsonld.cells(df).select(F.col("json_ld_types")).collect()] == ["X"]
