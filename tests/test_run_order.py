from gleanery.operators import frames
from gleanery.sources.runs import Folder


def test_the_later_row_of_a_run_is_the_newer(spark, tmp_path):
    """Whatever part files the rows of a run come in; assets too, which are dealt to a folder for each category."""
    folder = Folder(spark, f"{tmp_path}/base")
    rows = [(f"https://a.example/{i % 50}{'/' if i % 3 else ''}", str(i), i) for i in range(400)]
    pages = spark.createDataFrame(rows, "requested_url string, title string, seq long").repartition(16, "title")
    assets = spark.createDataFrame([("https://a.example/", f"https://a.example/f{u[18:].strip('/')}{'#' + t if n % 2 else ''}", ("pdf", "image")[n % 50 % 2], n) for u, t, n in rows], "referrer_page_url string, asset_url string, category string, seq long").repartition(16, "seq")
    folder.write_run("run_2024-01-01", {"pages": pages, "assets": assets})
    assert {r.title for r in frames.merge_pages(folder.table("pages")).collect()} == {str(i) for i in range(350, 400)}
    newest = {r.asset_url for r in frames.merge_assets(folder.table("assets")).collect()}
    assert newest == {f"https://a.example/f{i % 50}{'#' + str(i) if i % 2 else ''}" for i in range(350, 400)}
    for table in ("pages", "assets"):
        places = [r.seq for r in folder.table(table).collect()]
        assert len(set(places)) == len(places) == 400
