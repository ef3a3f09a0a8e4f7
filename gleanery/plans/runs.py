"""Runs written as folders of CSVs and read back, their catalogue and documents; and the frontier's decisions."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import fetching, urls
from gleanery.functions.scalars import filled
from gleanery.operators import frames
from gleanery.plans.registry import Site, host, query
from gleanery.session import shared_folder
from gleanery.sources.estate import RUNS
from gleanery.sources.runs import Folder


def written(s: Site, *tables: str) -> Folder:
    """The estate's runs as a folder of CSVs, in the folder that all executors share."""
    folder = Folder(s.spark, f"{shared_folder(s.spark)}/runs-{uuid.uuid4().hex}")
    names = {"pages": "pages_raw", "crawl_errors": "errors"}
    for run in RUNS:
        one = s.estate.of_runs(run)
        folder.write_run(run, {t: getattr(one, names.get(t, t)) for t in tables}, wanted=("edges", "tags"), name="First" if run == RUNS[0] else "")
    return folder


_TIMED = "CASE WHEN run = 'run_2024-01-01' THEN 'First (2024-01-01)' ELSE '2024-02-01' END"


@query("csv_catalogue", f"SELECT run AS name, CASE WHEN run = 'run_2024-01-01' THEN 'First' ELSE '' END AS friendly_name, substr(run, 5) AS timestamp, {_TIMED} AS label, count(*) AS page_count, CASE WHEN run = 'run_2024-01-01' THEN 'completed' ELSE 'interrupted' END AS status, FALSE AS has_config, run = 'run_2024-02-01' AS is_latest FROM pages_raw GROUP BY run")
def csv_catalogue(s: Site) -> DataFrame:
    """One run with a state, one without."""
    folder = written(s, "pages")
    folder.save_state(RUNS[0], status="completed", pages_crawled=1, queue=[["https://a.example/", "seed", 0]])
    return folder.catalogue()


@query("csv_pages", "SELECT run, requested_url, title, word_count, lang, date_published FROM pages_raw")
def csv_pages(s: Site) -> DataFrame:
    return written(s, "pages").table("pages").select("run", "requested_url", "title", "word_count", "lang", "date_published")


@query("csv_merged_pages", "SELECT run, requested_url, title FROM p")
def csv_merged_pages(s: Site) -> DataFrame:
    """Runs of CSVs merged as tables are: the newest row of each URL."""
    return frames.merge_pages(written(s, "pages").table("pages")).select("run", "requested_url", "title")


@query("csv_chosen_run", "SELECT requested_url FROM pages_raw WHERE run = 'run_2024-02-01'")
def csv_chosen_run(s: Site) -> DataFrame:
    """Names of runs that there aren't are known, and passed over."""
    folder = written(s, "pages")
    known, unknown = folder.chosen([RUNS[1], "run_1999-01-01"])
    assert (known, unknown) == ([RUNS[1]], ["run_1999-01-01"])
    return folder.table("pages", known).select("requested_url")


_SQL_FILED = "CASE WHEN category IN ('pdf', 'image', 'office', 'spreadsheet', 'archive', 'audio', 'video', 'font', 'stylesheet', 'script', 'xml', 'json') THEN category ELSE 'other' END"


@query("csv_assets", f"SELECT run, referrer_page_url, asset_url, {_SQL_FILED} AS category FROM assets")
def csv_assets(s: Site) -> DataFrame:
    """Of all categories' files; the category is the file's."""
    return written(s, "assets").table("assets").select("run", "referrer_page_url", "asset_url", "category")


@query("csv_asset_counts", "SELECT run, count(*) AS n FROM assets GROUP BY 1")
def csv_asset_counts(s: Site) -> DataFrame:
    folder = written(s, "assets")
    return s.spark.createDataFrame([(run, folder.asset_count(run)) for run in RUNS], "run string, n long")


@query(
    "csv_outputs",
    f"SELECT concat(f, '.csv') AS name, grp, n AS rows FROM (SELECT 'pages' AS f, 'pages' AS grp, count(*) AS n FROM pages_raw WHERE run = '{RUNS[0]}' UNION ALL SELECT 'edges', 'links', count(*) FROM edges WHERE run = '{RUNS[0]}' UNION ALL SELECT 'tags', 'metadata', count(*) FROM tags WHERE run = '{RUNS[0]}' UNION ALL SELECT 'crawl_errors', 'errors', count(*) FROM errors WHERE run = '{RUNS[0]}' UNION ALL SELECT concat('assets_', {_SQL_FILED}), 'assets', count(*) FROM assets WHERE run = '{RUNS[0]}' GROUP BY 1)",
)
def csv_outputs(s: Site) -> DataFrame:
    """A run's files by group. Navigation isn't asked for, so it isn't written."""
    return written(s, "pages", "edges", "tags", "nav_links", "crawl_errors", "assets").outputs(RUNS[0]).where("bytes > 0").select("name", "grp", "rows")


@query("content_hash_file", "SELECT requested_url AS url, max(content_hash) AS hash FROM pages_raw WHERE trim(content_hash) <> '' GROUP BY 1")
def content_hash_file(s: Site) -> DataFrame:
    folder = written(s)
    rows = s.estate.pages_raw.where(filled("content_hash")).groupBy(F.col("requested_url").alias("url")).agg(F.max("content_hash").alias("hash"))
    folder.save_hashes(RUNS[0], rows)
    return folder.load_hashes(RUNS[0])


@query("host_delays", f"SELECT h AS host, coalesce(f, 0) AS failures, 2.0 + CASE WHEN coalesce(f, 0) > 0 THEN least(2.0 * pow(2, least(f, 5)), 60.0) ELSE 0.0 END AS delay FROM (SELECT DISTINCT {host('url')} AS h FROM base) LEFT JOIN (SELECT {host('url')} AS e, count(*) AS f FROM base WHERE i % 3 > 0 AND i > coalesce((SELECT max(j.i) FROM base j WHERE j.i % 3 = 0 AND j.host = base.host), -1) GROUP BY 1) ON e = h")
def host_delays(s: Site) -> DataFrame:
    """Pages in their order, of which every third succeeds: the delay before each host's next fetch."""
    fetches = s.table("pages").select(urls.host("url").alias("host"), F.col("page_id").alias("at"), (F.col("page_id") % 3 > 0).alias("failed"))
    found = fetching.failures_in_a_row(fetches, "host", "at", "failed")
    return found.withColumn("delay", fetching.delay(F.lit(2.0), F.col("failures")))


@query("deferrals", "SELECT i, CASE WHEN i % 15 < 12 THEN CAST(i % 7 AS DOUBLE) + 1000000 END AS score, i % 15 >= 12 AS failed FROM base")
def deferrals(s: Site) -> DataFrame:
    """URLs answered 503: queued behind the others, at most twelve times."""
    i = F.col("page_id")
    score, failed = fetching.after_503((i % 7).cast("double"), i % 15)
    return s.table("pages").select(i.alias("i"), score.alias("score"), failed.alias("failed"))


_SQL_QUEUE = f"fr AS (SELECT i AS seq, url, CAST(i % 4 AS DOUBLE) AS score, {host('url')} AS h FROM base)"


def _frontier(s: Site) -> DataFrame:
    i = F.col("page_id")
    return s.table("pages").select(i.alias("seq"), "url", (i % 4).cast("double").alias("score"))


@query("frontier_next", "SELECT seq, url FROM fr ORDER BY score, seq LIMIT 10", _SQL_QUEUE)
def frontier_next(s: Site) -> DataFrame:
    return fetching.next_batch(_frontier(s), 10, one_a_host=False).select("seq", "url")


@query("frontier_next_hosts", "SELECT seq, url FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY score, seq) AS k FROM fr WHERE h NOT IN (SELECT h FROM fr WHERE seq < 3)) WHERE k = 1 ORDER BY score, seq LIMIT 10", _SQL_QUEUE)
def frontier_next_hosts(s: Site) -> DataFrame:
    """One of each host, none of hosts that are busy."""
    busy = s.table("pages").where("page_id < 3").select(urls.host("url").alias("host"))
    return fetching.next_batch(_frontier(s), 10, busy).select("seq", "url")


