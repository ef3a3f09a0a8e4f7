import csv
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gleanery.functions import rules
from gleanery.plans import exports
from gleanery.plans.registry import REPORTS, Site
from gleanery.sources import estate

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return estate.load(spark, DATA)


def test_runs_and_filters(tables):
    everything = REPORTS["noindex_summary"](Site(tables)).first().total
    one = REPORTS["noindex_summary"](Site(tables, runs=[estate.RUNS[1]])).first().total
    some = Site(tables, filters={"cms": ["drupal"]})
    assert 0 < one < everything and 0 < some.pages.count() < everything
    kept = {r.final_url for r in some.pages.select("final_url").collect()} | {r.requested_url for r in some.pages.select("requested_url").collect()}
    assert {r.page_url for r in some.tags.select("page_url").collect()} <= kept


def test_zip_and_json(tables):
    site, target = Site(tables), io.BytesIO()
    exports.to_zip(site, "indexability", target)
    with zipfile.ZipFile(target) as z:
        found = list(csv.DictReader(io.TextIOWrapper(z.open("noindex_pages.csv"), "utf-8")))
    assert len(found) == len(json.loads(exports.to_json(site, "noindex_pages"))) > 0
    exports.to_zip(Site(tables, filters={"domains": ["nowhere"]}), "key_metrics", empty := io.BytesIO())
    assert zipfile.ZipFile(empty).namelist() == ["readme.txt"]


@pytest.mark.parametrize(("state", "pages", "want"), [(None, 0, "new"), (None, 3, "interrupted"), ("new", 3, "interrupted"), ("running", 3, "running"), ("completed", 0, "completed")])
def test_run_status(spark, state, pages, want):
    assert spark.range(1).select(rules.run_status(F.lit(state).cast("string"), F.lit(pages))).first()[0] == want


def test_readability_and_stacks(spark):
    words = "The cat sat on the mat. " * 6
    row = spark.createDataFrame([(words, "too short", '<img src="/wp-content/a.png">')], "a string, b string, html string")
    got = row.select(rules.readability("a"), rules.readability("b"), rules.tech_stack("html", F.lit(""), F.lit("PHP"))).first()
    assert -3 < got[0] < 3 and got[1] is None and got[2] == "WordPress"
    assert row.select(rules.tokens_found("a", ["CAT", "dog", "mat"])).first()[0] == "CAT|mat"
