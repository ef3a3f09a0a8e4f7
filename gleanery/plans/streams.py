"""Event-time windows over the events table, in batch; some run as streams of files, and tests run the others so."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import urls
from gleanery.functions.scalars import content_hash
from gleanery.plans.registry import Site, host, query
from gleanery.session import shared_folder
from gleanery.sources import capture_source
from gleanery.streaming import captures, content, progress


def events(s: Site) -> DataFrame:
    # whole microseconds, without zone
    return s.table("events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_rate_tumbling", "SELECT CAST(epoch_us(time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP))) AS BIGINT) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_rate_tumbling(s: Site) -> DataFrame:
    return captures.tumbling(events(s), "ts", "1 hour", "event_type").select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("stream_rate_sliding", "SELECT start_us - k * 900000000 AS start_us, count(*) AS n FROM (SELECT CAST(epoch_us(time_bucket(INTERVAL 15 MINUTE, CAST(ts AS TIMESTAMP))) AS BIGINT) AS start_us FROM events), (SELECT unnest(range(0, 4)) AS k) GROUP BY 1")
def stream_rate_sliding(s: Site) -> DataFrame:
    return captures.sliding(events(s), "ts", "1 hour", "15 minutes").select(F.unix_micros("start").alias("start_us"), "n")


@query(
    "stream_sessions",
    "SELECT user_id, min(us) AS start_us, max(us) + 1800000000 AS end_us, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id) AS grp FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM (SELECT user_id, event_id, CAST(epoch_us(CAST(ts AS TIMESTAMP)) AS BIGINT) AS us FROM events))) GROUP BY user_id, grp",
)
def stream_sessions(s: Site) -> DataFrame:
    return captures.sessions(events(s), "ts", "30 minutes", "user_id").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("stream_dedup", "SELECT user_id, event_type, event_id, CAST(epoch_us(CAST(ts AS TIMESTAMP)) AS BIGINT) AS us FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def stream_dedup(s: Site) -> DataFrame:
    """The first event of each user and type."""
    rows = events(s).select("ts", "event_id", "user_id", "event_type")
    return captures.deduplicated(rows, "ts", "user_id", "event_type").select("user_id", "event_type", "event_id", F.unix_micros("ts").alias("us"))


@query("ingested_events", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def ingested_events(s: Site) -> DataFrame:
    """The events as a stream of files, written batch by batch and read back; a second start finds nothing new."""
    folder = f"{shared_folder(s.spark)}/ingest-{uuid.uuid4().hex}"
    rows = events(s).select("event_id", "event_type")
    rows.repartition(4).write.parquet(f"{folder}/in")
    stream = s.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    for _ in range(2):
        captures.ingest(stream, f"{folder}/out", f"{folder}/checkpoint", "event_type")
    return s.spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


_SQL_HOSTS = "ev AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 7, ts ORDER BY event_id) AS k FROM events) WHERE k = 1)"


@query("streamed_hosts", "SELECT host, count(*) AS n, count(*) FILTER (bad) AS failed, count(*) FILTER (tm > last) AS in_a_row FROM (SELECT CAST(user_id % 7 AS VARCHAR) AS host, ts AS tm, event_id % 3 = 0 AS bad, coalesce(max(CASE WHEN event_id % 3 <> 0 THEN ts END) OVER (PARTITION BY user_id % 7), TIMESTAMP '1970-01-01') AS last FROM ev) GROUP BY 1", _SQL_HOSTS)
def streamed_hosts(s: Site) -> DataFrame:
    """State of each host, as a stream in two batches leaves it. Events of one host and time count once, so that their order is
    known. What a batch updates is written by executors, under the batch's number; the newest row of each host stands."""
    folder = f"{shared_folder(s.spark)}/hosts-{uuid.uuid4().hex}"
    named = events(s).select((F.col("user_id") % 7).cast("string").alias("host"), "ts", "event_id")
    rows = named.groupBy("host", "ts").agg(F.min("event_id").alias("event_id")).withColumn("status", F.when(F.col("event_id") % 3 == 0, 500).otherwise(200))
    half = rows.agg(F.percentile_approx(F.unix_micros("ts"), 0.5)).first()[0] or 0
    for part in (F.unix_micros("ts") <= half, F.unix_micros("ts") > half):
        rows.where(part).write.mode("append").parquet(f"{folder}/in")
        stream = s.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        captures.ingest(captures.host_state(stream, "host", "status", "ts", idle="400 days"), f"{folder}/out", f"{folder}/checkpoint", None, "update")
    newest = s.spark.read.parquet(f"{folder}/out").groupBy("host").agg(F.max_by(F.struct("n", "failed", "in_a_row"), "batch").alias("x"))
    return newest.select("host", "x.*")


def _in_parts(s: Site, rows: DataFrame, folder: str, *parts: str) -> Iterator[DataFrame]:
    """rows as a stream of files, to which one part after the other is added."""
    for part in parts:
        rows.where(part).write.mode("append").parquet(f"{folder}/in")
        yield s.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")


_SQL_FIRST = "SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS hash, first_value(doc_id) OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id % 2, doc_id) AS f FROM documents"


@query("streamed_content", f"SELECT CAST(doc_id AS VARCHAR) AS name, hash, CASE WHEN f = doc_id THEN 'accepted' ELSE 'content_duplicate' END AS outcome, CAST(f AS VARCHAR) AS first FROM ({_SQL_FIRST})")
def streamed_content(s: Site) -> DataFrame:
    """Documents as a stream that is stopped and goes on: accepted where their content is new, duplicates with the one they repeat."""
    folder = f"{shared_folder(s.spark)}/content-{uuid.uuid4().hex}"
    rows = s.spread_table("documents").select("doc_id", content_hash("text").alias("hash"))
    for stream in _in_parts(s, rows, folder, "doc_id % 2 = 0", "doc_id % 2 = 1"):
        content.run_through(content.first_wins(stream, "doc_id", "hash", "doc_id"), f"{folder}/out", f"{folder}/checkpoint")
    return s.spark.read.parquet(f"{folder}/out")


@query("contents_in_state", f"SELECT DISTINCT hash, CAST(f AS VARCHAR) AS name FROM ({_SQL_FIRST})")
def contents_in_state(s: Site) -> DataFrame:
    """What such a stream remembers, read from its checkpoint: each content and who had it first."""
    folder = f"{shared_folder(s.spark)}/content-{uuid.uuid4().hex}"
    rows = s.spread_table("documents").select("doc_id", content_hash("text").alias("hash"))
    for stream in _in_parts(s, rows, folder, "doc_id % 2 = 0", "doc_id % 2 = 1"):
        content.run_through(content.first_wins(stream, "doc_id", "hash", "doc_id"), f"{folder}/out", f"{folder}/checkpoint")
    return content.state_of(s.spark, f"{folder}/checkpoint", content.STATE).select("hash", "name")


@query("visited_from_state", "SELECT DISTINCT user_id, event_type FROM events")
def visited_from_state(s: Site) -> DataFrame:
    """Events as visits: a stream is stopped after half of them and goes on; what it has visited is rebuilt from its state alone, and
    held against what it gave."""
    folder = f"{shared_folder(s.spark)}/visits-{uuid.uuid4().hex}"
    rows = events(s).select("event_id", "user_id", "event_type")
    for stream in _in_parts(s, rows, folder, "event_id % 2 = 0", "event_id % 2 = 1"):
        content.run_through(content.visited(stream, "user_id", "event_type"), f"{folder}/out", f"{folder}/checkpoint")
    keys = content.state_of(s.spark, f"{folder}/checkpoint").select("user_id", "event_type")
    given = s.spark.read.parquet(f"{folder}/out").select("user_id", "event_type")
    return keys.join(given, ["user_id", "event_type"], "full_outer")


def _runs(s: Site) -> tuple[DataFrame, DataFrame]:
    """Two runs of the pages: the second lacks some, has others anew, and some of another content; times are a day apart, and some of
    the second's rows are late. A run takes half a day, however many pages it has, so that none of its rows is later than watermarks
    allow for."""
    i = F.col("page_id")
    rows = s.table("pages").select("page_id", "url", F.sha2("html", 256).alias("hash"))
    second = 1_704_067_200 + i % 43_200
    start = F.timestamp_seconds(second)
    before = rows.where(i % 11 != 4).select(F.concat("url", F.lit("#"), i.cast("string")).alias("key"), "hash", start.alias("at"), i.alias("n"))
    changed = F.when(i % 5 == 0, F.concat("hash", F.lit("x"))).otherwise(F.col("hash"))
    later = F.timestamp_seconds(second + 86_400 - F.when(i % 9 == 0, 3_600).otherwise(0))
    return before, rows.where(i % 7 != 3).select(F.concat("url", F.lit("#"), i.cast("string")).alias("key"), changed.alias("hash"), later.alias("at"), i.alias("n"))


_SQL_CHANGE = "SELECT concat(url, '#', CAST(page_id AS VARCHAR)) AS key, CASE WHEN page_id % 11 = 4 THEN 'new' WHEN page_id % 7 = 3 THEN 'vanished' WHEN page_id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM pages WHERE NOT (page_id % 11 = 4 AND page_id % 7 = 3)"


@query("changed_between_runs", _SQL_CHANGE)
def changed_between_runs(s: Site) -> DataFrame:
    before, now = _runs(s)
    return content.changes(before, now, "key", "hash", "at")


@query("changed_between_streams", _SQL_CHANGE)
def changed_between_streams(s: Site) -> DataFrame:
    """Both runs as streams, each in two parts of which the second holds the late rows; then a row far ahead in each, which moves the
    watermark past all the others."""
    folder = f"{shared_folder(s.spark)}/changes-{uuid.uuid4().hex}"
    before, now = _runs(s)
    ahead = s.spark.createDataFrame([("", "", 1_800_000_000, 0)], "key string, hash string, t long, n long").select("key", "hash", F.timestamp_seconds("t").alias("at"), "n")
    for part in ("n % 9 <> 0", "n % 9 = 0", None):
        for name, rows in (("before", before), ("now", now)):
            (ahead if part is None else rows.where(part)).select("key", "hash", "at").write.mode("append").parquet(f"{folder}/{name}")
        old, new = (s.spark.readStream.schema("key string, hash string, at timestamp").parquet(f"{folder}/{name}") for name in ("before", "now"))
        content.run_through(content.changes(old, new, "key", "hash", "at"), f"{folder}/out", f"{folder}/checkpoint")
    return s.spark.read.parquet(f"{folder}/out").where("key <> ''")


@query("changed_since_run", f"SELECT * FROM ({_SQL_CHANGE}) WHERE change <> 'vanished'")
def changed_since_run(s: Site) -> DataFrame:
    """The second run as a stream against the first as a table."""
    folder = f"{shared_folder(s.spark)}/since-{uuid.uuid4().hex}"
    before, now = _runs(s)
    for stream in _in_parts(s, now.select("key", "hash", "n"), folder, "n % 2 = 0", "n % 2 = 1"):
        content.run_through(content.changed_since(stream.select("key", "hash"), before, "key", "hash").select("key", "change"), f"{folder}/out", f"{folder}/checkpoint")
    return s.spark.read.parquet(f"{folder}/out")


def _captured(s: Site) -> str:
    """The pages as captures, in three batches of files by host."""
    folder = f"{shared_folder(s.spark)}/captures-{uuid.uuid4().hex}"
    rows = s.table("pages").select("page_id", "url", F.lit(200).alias("http_status"), F.lit("text/html").alias("content_type"), "html", F.create_map(F.lit("etag"), F.col("page_id").cast("string")).alias("headers"))
    for n in range(3):
        capture_source.write_captures(rows.where(F.col("page_id") % 3 == n).drop("page_id"), folder, n)
    capture_source.register(s.spark)
    return folder


_SQL_CAPTURED = f"SELECT CAST(page_id % 3 AS INT) AS batch, {host('url')} AS host, count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS chars, CAST(sum(page_id) AS BIGINT) AS etags FROM pages {{where}} GROUP BY ALL"


def _summed(df: DataFrame) -> DataFrame:
    return df.groupBy("batch", "host").agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("chars"), F.sum(F.col("headers")["etag"].cast("long")).alias("etags"))


@query("captures_read", _SQL_CAPTURED.format(where=""))
def captures_read(s: Site) -> DataFrame:
    return _summed(s.spark.read.format("captures").load(_captured(s)))


@query("captures_of_hosts", _SQL_CAPTURED.format(where=f"WHERE {host('url')} IN (SELECT {host('url')} FROM pages WHERE page_id < 5)"))
def captures_of_hosts(s: Site) -> DataFrame:
    """Filters on hosts reach the source, which leaves out the files of others."""
    hosts = [r.h for r in s.table("pages").where("page_id < 5").select(urls.host("url").alias("h")).distinct().collect()]
    return _summed(s.spark.read.format("captures").load(_captured(s)).where(F.col("host").isin(*hosts)))


@query("captures_streamed", _SQL_CAPTURED.format(where=""))
def captures_streamed(s: Site) -> DataFrame:
    """The same folder as a stream."""
    folder = _captured(s)
    content.run_through(s.spark.readStream.format("captures").load(folder), f"{folder}-out", f"{folder}-checkpoint")
    return _summed(s.spark.read.parquet(f"{folder}-out"))


@query("stream_progress", "SELECT 2 AS batches, count(*) AS rows, 1 AS ends FROM events")
def stream_progress(s: Site) -> DataFrame:
    """What a listener noted of an ingestion of the events in two batches of files."""
    folder = f"{shared_folder(s.spark)}/progress-{uuid.uuid4().hex}"
    rows = events(s).select("event_id", "event_type")
    rows.repartition(4).write.parquet(f"{folder}/in")
    with progress.Progress(s.spark, f"{folder}/progress") as listener:
        stream = s.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
        captures.ingest(stream, f"{folder}/out", f"{folder}/checkpoint", "event_type")
    noted = listener.table()
    return noted.agg(F.count_if(F.col("rows") > 0).cast("int").alias("batches"), F.sum("rows").alias("rows"), F.count_if(F.col("ended") & (F.col("error") == "")).cast("int").alias("ends"))
