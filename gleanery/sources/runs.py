"""Runs as folders: `run_*` below a base, one CSV for each table and one for each category of assets, and small JSON documents
beside them. A CSV is a file or, as Spark writes it, a folder of part files; either is read.

Folders and documents go through Hadoop's file systems, so that a base may lie wherever Spark reads from. Only names, sizes
and documents of a run pass through the driver; rows don't.
"""

from __future__ import annotations

import csv
import json
import re
import uuid
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.rules import run_status
from gleanery.functions.urls import ASSET_CATEGORIES
from gleanery.sources.tables import _CSV, FIELDS, write_csv

STATE, HASHES, NAME, LATEST, CONFIG = "_state.json", "_content_hashes.json", ".name", ".latest", "_config.json"
CATEGORIES = (*dict.fromkeys(ASSET_CATEGORIES.values()), "other")
#: Tables that are written only where the run asks for them.
OPTIONAL = ("edges", "tags", "nav_links", "sitemap_urls", "link_checks", "keyword_log")
#: Groups of files on a results page.
GROUPS = {"pages": "pages", "edges": "links", "nav_links": "links", "link_checks": "links", "sitemap_urls": "sitemaps", "crawl_errors": "errors"}


class Folder:
    """A base folder of runs."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    # Folders and documents

    def names(self, *below: str) -> list[tuple[str, bool]]:
        """Names below a folder, and whether each is a folder; none where there is no such folder."""
        at = self._path("/".join((self.base, *below)))
        if not self._fs.exists(at):
            return []
        return sorted((x.getPath().getName(), x.isDirectory()) for x in self._fs.listStatus(at))

    def size(self, *below: str) -> int:
        return self._fs.getContentSummary(self._path("/".join((self.base, *below)))).getLength()

    def read(self, *below: str) -> str | None:
        """A document, or None where there is none."""
        at = self._path("/".join((self.base, *below)))
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, text: str, *below: str) -> None:
        stream = self._fs.create(self._path("/".join((self.base, *below))), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def delete(self, *below: str) -> None:
        self._fs.delete(self._path("/".join((self.base, *below))), True)

    # Runs

    def runs(self) -> list[str]:
        """In order, the oldest first."""
        return [n for n, is_folder in self.names() if is_folder and n.startswith("run_")]

    def chosen(self, names: Sequence[str] = ()) -> tuple[list[str], list[str]]:
        """Of the runs asked for (all, if none) those there are, and the names of which there is no run."""
        known = self.runs()
        return [r for r in known if not names or r in names], [n for n in names if n not in known]

    def save_state(self, run: str, **state) -> None:
        """Progress of a run: status, counts, queue, when it began and stopped."""
        self.write(json.dumps(state, ensure_ascii=False), run, STATE)

    def load_state(self, run: str) -> dict | None:
        text = self.read(run, STATE)
        return None if text is None else json.loads(text)

    def catalogue(self) -> DataFrame:
        """Of each run, the newest first: name, friendly_name, timestamp, label, page_count, status, has_config, is_latest."""
        latest = (self.read(LATEST) or "").strip()
        rows = []
        for run in reversed(self.runs()):
            day, _, time = run.removeprefix("run_").partition("_")
            stamp = f"{day} {time.partition('_')[0].replace('-', ':')}".strip()
            friendly = (self.read(run, NAME) or "").strip()
            rows.append((run, friendly, stamp, f"{friendly} ({stamp})" if friendly else stamp, (self.load_state(run) or {}).get("status"), self.read(run, CONFIG) is not None, run == latest))
        listed = self.spark.createDataFrame(rows, "name string, friendly_name string, timestamp string, label string, state string, has_config boolean, is_latest boolean")
        pages = self.table("pages").groupBy(F.col("run").alias("name")).agg(F.count("*").alias("page_count"))
        found = listed.join(F.broadcast(pages), "name", "left").fillna(0, ["page_count"])
        return found.select("name", "friendly_name", "timestamp", "label", "page_count", run_status(F.col("state"), F.col("page_count")).alias("status"), "has_config", "is_latest").orderBy(F.desc("name"))

    # Tables

    def _files(self, run: str, table: str) -> list[str]:
        pattern = re.compile(r"assets_.*\.csv" if table == "assets" else re.escape(table) + r"\.csv")
        return [n for n, _ in self.names(run) if pattern.fullmatch(n)]

    def table(self, name: str, runs: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
        """A table of some runs (all, if none are named), with run, and seq: a row's place in its run's files. Cells are strings;
        columns that a file lacks are blank. Assets have the category that their file is named by, too. Files of one header are
        read together, however many runs they are of."""
        names = tuple(columns or FIELDS[name])
        headers: dict[tuple[str, ...], list[str]] = {}
        for run in self.chosen(runs)[0]:
            for file in self._files(run, name):
                path = f"{self.base}/{run}/{file}"
                headers.setdefault(tuple(self._header(path)), []).append(path)
        parts = [self._read(paths, header, names, name) for header, paths in headers.items() if header]
        if not parts:
            return self.spark.createDataFrame([], ", ".join([*(f"`{c}` string" for c in names), "run string", "seq long"]))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _header(self, path: str) -> list[str]:
        """Column names of a CSV, from its first line; none of an empty one. A few bytes of each file are read, and no job is run."""
        at = self._path(path)
        files = [at] if self._fs.getFileStatus(at).isFile() else sorted((x.getPath() for x in self._fs.listStatus(at) if x.getLen() and not x.getPath().getName().startswith(("_", "."))), key=str)
        if not files or not self._fs.getFileStatus(files[0]).getLen():
            return []
        java = self.spark._jvm.java.io
        lines = java.BufferedReader(java.InputStreamReader(self._fs.open(files[0]), "UTF-8"))
        try:
            return next(csv.reader([(lines.readLine() or "").removeprefix("\ufeff")]), [])
        finally:
            lines.close()

    def _read(self, paths: list[str], header: tuple[str, ...], names: tuple[str, ...], table: str) -> DataFrame:
        df = self.spark.read.options(**_CSV).schema(", ".join(f"`{c}` string" for c in header)).csv(paths)
        file = F.col("_metadata.file_path")
        given = {c: F.coalesce(F.col(f"`{c}`"), F.lit("")) if c in header else F.lit("") for c in names}
        if table == "assets":
            given["category"] = F.regexp_extract(file, r"/assets_([^/]*)\.csv", 1)
        # by part file, in the order in which they were written, then by place in it: unlike within a run, but for assets of one category
        part = F.regexp_extract(file, r"/part-(\d+)[^/]*$", 1).try_cast("long")
        further = F.coalesce(F.regexp_extract(file, r"-c(\d+)[^/]*$", 1).try_cast("long"), F.lit(0))
        category = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.regexp_extract(file, r"/assets_([^/]*)\.csv", 1))
        number = F.pmod(F.coalesce(part, F.when(file.endswith(".csv") & ~F.contains(file, F.lit(".csv/")), 0).otherwise(F.xxhash64(file))), F.lit(1 << 20))
        place = number * (1 << 43) + F.pmod(further, F.lit(32)) * (1 << 38) + category * (1 << 34) + F.col("_metadata.file_block_start") + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33))
        return df.select(*(c.alias(n) for n, c in given.items()), F.regexp_extract(file, r"/(run_[^/]*)/", 1).alias("run"), place.alias("seq"))

    def write_run(self, run: str, frames: Mapping[str, DataFrame], wanted: Sequence[str] = (), name: str = "") -> None:
        """The tables of a run as CSVs, in the order of seq where they have it, as the later of a run's rows is the newer: pages, assets, errors and phone numbers always, of OPTIONAL those that are wanted. Assets
        go to one file for each category; an unknown one is `other`. Part files are written by the executors; a run that is
        written again replaces what it wrote."""
        for table, df in frames.items():
            if table in OPTIONAL and table not in wanted:
                continue
            if table == "assets":
                self._write_assets(run, df)
            else:
                write_csv(df, f"{self.base}/{run}/{table}.csv", FIELDS[table])
        if name:
            self.write(name.strip(), run, NAME)
        self.write(run, LATEST)

    def _write_assets(self, run: str, df: DataFrame) -> None:
        """One pass over the rows, and a folder for each category, moved to its place."""
        known = F.when(F.col("category").isin(*CATEGORIES), F.col("category")).otherwise(F.lit("other"))
        draft = f".assets-{uuid.uuid4().hex}"
        write_csv(df.withColumn("category", known), f"{self.base}/{run}/{draft}", FIELDS["assets"], by="category")
        for old in self._files(run, "assets"):
            self.delete(run, old)
        for folder, _ in self.names(run, draft):
            if folder.startswith("_by="):
                self._fs.rename(self._path(f"{self.base}/{run}/{draft}/{folder}"), self._path(f"{self.base}/{run}/assets_{folder.removeprefix('_by=')}.csv"))
        self.delete(run, draft)

    def asset_count(self, run: str) -> int:
        """Records of all of a run's asset files."""
        return self.table("assets", [run]).count()

    def outputs(self, run: str) -> DataFrame:
        """The CSVs of a run: name, group, bytes, and rows as lines after the first, in one scan of them all: a cell with a line end in
        it counts twice, as it does in the listings of other tools."""
        files = [(n, _group(n), self.size(run, n)) for n, _ in self.names(run) if n.endswith(".csv")]
        listed = self.spark.createDataFrame(files, "name string, grp string, bytes long")
        paths = [f"{self.base}/{run}/{n}" for n, _, size in files if size]
        if not paths:
            return listed.withColumn("rows", F.lit(0).cast("long"))
        lines = self.spark.read.text(paths).groupBy(F.col("_metadata.file_path").alias("file")).agg((F.count("*") - 1).alias("rows"))
        counted = lines.groupBy(F.regexp_extract("file", r"/run_[^/]*/([^/]*[.]csv)", 1).alias("name")).agg(F.sum("rows").alias("rows"))
        return listed.join(F.broadcast(counted), "name", "left").fillna(0, ["rows"])

    # Content hashes

    def save_hashes(self, run: str, hashes: DataFrame) -> None:
        """url and hash of each page, as lines of JSON."""
        hashes.select("url", "hash").write.mode("overwrite").json(f"{self.base}/{run}/{HASHES}")

    def load_hashes(self, run: str) -> DataFrame:
        """url and hash; of a file that holds one JSON object, as other tools write it, its names and values: that one is a
        document, which passes through the driver. None where there is no such file."""
        is_folder = dict(self.names(run)).get(HASHES)
        if is_folder is None:
            return self.spark.createDataFrame([], "url string, hash string")
        if is_folder:
            return self.spark.read.schema("url string, hash string").json(f"{self.base}/{run}/{HASHES}")
        whole = self.spark.createDataFrame([(self.read(run, HASHES),)], "value string")
        return whole.select(F.explode(F.coalesce(F.from_json("value", "map<string,string>"), F.create_map().cast("map<string,string>"))).alias("url", "hash"))


def _group(name: str) -> str:
    table = name.removesuffix(".csv")
    return "assets" if table.startswith("assets_") else GROUPS.get(table, "metadata")


def states(folder: Folder) -> Iterator[tuple[str, dict | None]]:
    """Each run with its state."""
    for run in folder.runs():
        yield run, folder.load_state(run)
