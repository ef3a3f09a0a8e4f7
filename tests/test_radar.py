from gleanery.plans.registry import REPORTS, Site
from gleanery.sources import estate


def test_scores_are_against_all_domains(spark):
    """Words and links are measured against the greatest of all domains with enough pages, whether it is shown or not."""
    site = Site(estate.load(spark, "/root/testdata/sf0.01"))
    everyone = {r.domain: r for r in REPORTS["quality_radar"](site, least=1, most=1000).collect()}
    some = REPORTS["quality_radar"](site, least=1, most=2).collect()
    assert len(some) == 2 < len(everyone) and all(r == everyone[r.domain] for r in some)
