"""What the order of a cut report leaves open is settled by the other columns, not by how rows came."""

import pytest

from gleanery.plans.registry import REPORTS, Site
from gleanery.sources import estate


@pytest.mark.parametrize("name", ["audit_image_pages", "audit_title_meta_pages", "jobs_listed", "recipes_listed", "top_rated_products"])
def test_the_same_rows_however_they_come(spark, name):
    columns = "final_url string, domain string, title string, meta_description string, img_count string, img_missing_alt_count string, schema_job_title string, schema_job_location string, schema_recipe_time string, schema_price string, schema_rating string, schema_review_count string"
    rows = [("", f"d{i:03}", "t", "", "2", "1", "Nurse", "Leeds", "PT1H", "3", "4.5", "1") for i in range(130)]
    found = []
    for given in (rows, rows[::-1]):
        site = Site(estate.Estate(*[None] * 7))
        site.pages = spark.createDataFrame(given, columns).coalesce(1)
        found.append(sorted(r.domain for r in REPORTS[name](site).collect()))
    assert found[0] == found[1] == [f"d{i:03}" for i in range(len(found[0]))]
