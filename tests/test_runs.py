"""Runs as folders, what is fetched when, parameters, exports and functions by name."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gleanery import surface
from gleanery.functions import fetching, scalars
from gleanery.plans import exports
from gleanery.plans.registry import REPORTS, Site, parse_filters, parse_parameters, report
from gleanery.sources import estate, tables
from gleanery.sources.runs import Folder

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def site(spark):
    return Site(estate.load(spark, DATA), spark=spark, folder=DATA)


def pages(spark, *rows):
    return spark.createDataFrame(rows, "requested_url string, title string, extra string")


def test_a_folder_of_runs(spark, tmp_path):
    folder = Folder(spark, f"{tmp_path}/base")
    assert folder.runs() == [] and folder.catalogue().collect() == [] and folder.table("pages").collect() == []
    folder.write_run("run_2024-01-01_10-00-00", {"pages": pages(spark, ("u1", 'say "hi",\nthere', "x"), ("u2", None, "x"))}, name=" Mine ")
    folder.write_run("run_2024-02-01_11-30-00", {"pages": pages(spark, ("u1", "new", "x")), "nav_links": pages(spark, ("a", "b", "c"))})
    (tmp_path / "base" / "run_2024-03-01").mkdir()
    (tmp_path / "base" / "other").mkdir()
    assert folder.runs() == ["run_2024-01-01_10-00-00", "run_2024-02-01_11-30-00", "run_2024-03-01"]
    rows = {(r.run[4:11], r.requested_url): r.title for r in folder.table("pages").collect()}
    assert rows == {("2024-01", "u1"): 'say "hi",\nthere', ("2024-01", "u2"): "", ("2024-02", "u1"): "new"}
    assert set(tables.FIELDS["pages"]) <= set(folder.table("pages").columns) and "extra" not in folder.table("pages").columns
    got = folder.catalogue().collect()
    assert [(r.label, r.page_count, r.status, r.is_latest) for r in got] == [("2024-03-01", 0, "new", False), ("2024-02-01 11:30:00", 1, "interrupted", True), ("Mine (2024-01-01 10:00:00)", 2, "interrupted", False)]
    assert not any(n == "nav_links.csv" for n, _ in folder.names("run_2024-02-01_11-30-00"))
    assert folder.chosen(["run_2024-03-01", "nowhere"]) == (["run_2024-03-01"], ["nowhere"])


def test_plain_files_are_read_too(spark, tmp_path):
    run = tmp_path / "base" / "run_1"
    run.mkdir(parents=True)
    (run / "pages.csv").write_text('"requested_url","depth"\n"u","2"\n"v","a\nb"\n')
    (run / "crawl_errors.csv").write_text("")
    (run / "assets_pdf.csv").write_text('"referrer_page_url","asset_url"\n"u","f"\n')
    (run / "assets_odd.csv").write_text('"referrer_page_url","asset_url","category"\n"u","g","else"\n')
    (run / "_content_hashes.json").write_text('{"u": "h"}')
    folder = Folder(spark, f"{tmp_path}/base")
    assert sorted((r.requested_url, r.depth, r.title) for r in folder.table("pages").collect()) == [("u", "2", ""), ("v", "a\nb", "")]
    assert folder.table("crawl_errors").collect() == [] and folder.asset_count("run_1") == 2
    assert {(r.asset_url, r.category) for r in folder.table("assets").collect()} == {("f", "pdf"), ("g", "odd")}
    assert {(r.name, r.grp, r.rows) for r in folder.outputs("run_1").collect()} == {("pages.csv", "pages", 3), ("crawl_errors.csv", "errors", 0), ("assets_pdf.csv", "assets", 1), ("assets_odd.csv", "assets", 1)}
    assert [tuple(r) for r in folder.load_hashes("run_1").collect()] == [("u", "h")]
    order = folder.table("pages").orderBy("seq").collect()
    assert [r.requested_url for r in order] == ["u", "v"]


def test_unknown_categories_are_other(spark, tmp_path):
    folder = Folder(spark, str(tmp_path))
    rows = spark.createDataFrame([("p", "a", "pdf"), ("p", "b", "weird"), ("p", "c", None)], "referrer_page_url string, asset_url string, category string")
    folder.write_run("run_1", {"assets": rows})
    assert {(r.asset_url, r.category) for r in folder.table("assets").collect()} == {("a", "pdf"), ("b", "other"), ("c", "other")}


def test_missing_files_have_no_rows_and_broken_ones_raise(spark, tmp_path):
    assert tables.read_csv(spark, f"{tmp_path}/none.csv", ("a", "b")).collect() == []
    with pytest.raises(Exception):
        tables.read_csv(spark, "nosuchscheme://x/y.csv")


def test_cells_are_cut_only_where_asked(spark):
    long = spark.createDataFrame([("x" * 40_000,)], "c string")
    assert long.select(F.length(scalars.sanitised("c", None))).first()[0] == 40_000


def plain_batch(rows, n, busy):
    taken, out = set(busy), []
    for score, seq, host in sorted(rows):
        if host and host in taken:
            continue
        taken.add(host)
        out.append(seq)
    return out[:n]


def test_batches_of_the_frontier(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0.0, 1.0, 2.0]), i, rng.choice(["a.com", "b.com", "c.com", ""])) for i in range(60)]
    df = spark.createDataFrame([(f"https://{h}/{i}" if h else f"/x{i}", s, i) for s, i, h in rows], "url string, score double, seq long").repartition(4)
    busy = spark.createDataFrame([("b.com",), (None,)], "host string")
    assert [r.seq for r in fetching.next_batch(df, 20, busy).collect()] == plain_batch(rows, 20, {"b.com"})
    assert [r.seq for r in fetching.next_batch(df, 7, one_a_host=False).collect()] == [i for _, i, _ in sorted(rows)[:7]]


@pytest.mark.parametrize(("failures", "want"), [(0, 3.0), (1, 9.0), (2, 15.0), (4, 51.0), (5, 63.0), (50, 63.0)])
def test_delays(spark, failures, want):
    assert spark.range(1).select(fetching.delay(F.lit(3.0), F.lit(failures))).first()[0] == want


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("", {}),
        ("domains=a.com,%20b.com,&cms=", {"domains": ["a.com", "b.com"]}),
        ("date_from=2024-01-01&min_coverage=50.5&other=1", {"date_from": "2024-01-01", "min_coverage": 50.5}),
        ("min_coverage=many&schema_types=Article", {"schema_types": ["Article"]}),
    ],
)
def test_filters_of_a_query(given, want):
    assert parse_filters(given) == want


def test_parameters_of_reports(site):
    assert parse_parameters("full=TRUE&top=3&depth=x") == {"full": True, "top": 3} and parse_parameters("full=no") == {}
    assert report("thin_content_report", site, top=3).count() == 3
    assert report("thin_content_report", site, full=True).count() >= report("thin_content_report", site).count()
    assert report("chord_matrix", site, top=4, full=False).count() == 16
    assert report("nav_tree", site, depth=1).count() == REPORTS["nav_tree"](site).count()
    assert report("content_health", site, top=3, depth=2).count() > 0


def test_exports(site, spark, tmp_path):
    whole = json.loads(exports.to_json(site, "indexability"))
    assert set(whole) == set(exports.BUNDLES["indexability"]) and whole["noindex_summary"][0]["total"] > 0
    names = exports.to_folder(site, "technical", f"{tmp_path}/t", full=True)
    assert tables.count_rows(spark, f"{tmp_path}/t/{names[0]}.csv") == REPORTS[names[0]](site).count()
    exports.to_folder(site, "key_metrics", f"{tmp_path}/j", kind="json")
    assert spark.read.json(f"{tmp_path}/j/key_metrics.json").count() == REPORTS["key_metrics"](site).count()


def test_functions_by_name(spark):
    names = surface.register(spark)
    assert {"url_host", "page_tags"} <= set(names)
    rows = spark.sql("SELECT url_host('https://u@A.com:8/x') AS h, url_host('http://[::1]:80/') AS six, safe_int(' 7 ') AS n, safe_int('7.0') AS z, is_filled(' ') AS f").first()
    assert tuple(rows) == ("a.com", "::1", 7, 0, False)
    assert [tuple(r) for r in spark.sql("SELECT t.* FROM page_tags('https://a.com/', '<meta name=keywords content=\"x;y\">') t").collect()] == [("x", "meta:keywords"), ("y", "meta:keywords")]
