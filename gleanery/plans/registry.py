"""Queries beside the SQL that says the same, and the frames and statements that both start from."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property
from inspect import signature
from urllib.parse import parse_qs

from pyspark.sql import DataFrame, SparkSession

from gleanery.operators import frames
from gleanery.session import spread
from gleanery.sources import estate, kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The same by name over any Site.
REPORTS: dict[str, Callable[[Site], DataFrame]] = {}


class Site:
    """An estate as reports see it: its runs merged, its pages filtered after that. `filters` are filter_pages' own."""

    def __init__(self, tables: estate.Estate, runs: Sequence[str] = (), filters: dict | None = None, spark: SparkSession | None = None, folder: str = ""):
        self.estate = tables.of_runs(*runs) if runs else tables
        self.runs, self.merging = tuple(runs), 1 if len(runs) == 1 else 2
        self.filters, self.spark, self.folder = filters or {}, spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread_table(self, name: str) -> DataFrame:
        """For work that costs far more than reading."""
        return spread(self.table(name))

    #: Estate tables by the kinds that they are merged as.
    _KINDS = {"pages": "pages_raw", "edges": "edges", "tags": "tags", "nav": "nav_links", "assets": "assets", "errors": "errors"}

    @cached_property
    def _inputs(self) -> tuple[list, int]:
        files = kept.files_of(self.table("pages"))
        return files, sum(size for _, size, _ in files)

    def clustered(self, kind: str) -> DataFrame:
        """All runs' rows of a table, dealt and sorted by what they are merged by: made once for the files below the folder."""
        files, size = self._inputs
        name = self._KINDS[kind]
        return kept.kept(self.spark, name, lambda: frames.keyed(getattr(self.estate, name), kind), files, estate.TABLES[name], estate.TABLES["base"], keys=frames.key_names(kind), size=size)

    def _merged(self, kind: str) -> DataFrame:
        """The newest rows of a table. Over a folder's files and all their runs they are made once and kept, for all reports."""
        name = self._KINDS[kind]
        if self.spark is None or not self.folder or self.runs:
            return frames.merge_runs(getattr(self.estate, name), kind, self.merging)
        files, size = self._inputs
        made = lambda: frames.merge_runs(self.clustered(kind), kind, self.merging)
        return kept.kept(self.spark, f"merged_{name}", made, files, self.merging, estate.TABLES[name], estate.TABLES["base"], size=size)

    @cached_property
    def all_pages(self) -> DataFrame:
        return self._merged("pages")

    @cached_property
    def pages(self) -> DataFrame:
        return frames.filter_pages(self.all_pages, **self.filters)

    def _of_pages(self, df: DataFrame, column: str) -> DataFrame:
        """Rows of the pages that the filters leave, where there are filters."""
        return frames.restrict(df, column, self.pages) if self.filters else df

    @cached_property
    def edges(self) -> DataFrame:
        return self._of_pages(self._merged("edges"), "from_url")

    @cached_property
    def tags(self) -> DataFrame:
        return self._of_pages(self._merged("tags"), "page_url")

    @cached_property
    def nav(self) -> DataFrame:
        return self._merged("nav")

    @cached_property
    def assets(self) -> DataFrame:
        return self._of_pages(self._merged("assets"), "referrer_page_url")

    @cached_property
    def errors(self) -> DataFrame:
        return frames.without_succeeded(self._merged("errors"), self.all_pages)


def report(name: str, site: Site, **given) -> DataFrame:
    """A report by name. `full` lifts its caps, `top` sets them, `depth` its levels; what a report doesn't take is passed over, so
    that one set of parameters serves them all."""
    takes = signature(REPORTS[name]).parameters
    wanted = {k: v for k, v in given.items() if k in takes}
    if (cap := next((c for c in ("cap", "n", "most") if c in takes), None)) is not None:
        if given.get("full") and takes[cap].default is not None and "None" in str(takes[cap].annotation):
            wanted[cap] = None
        elif given.get("top") is not None:
            wanted[cap] = given["top"]
    if "depth" in wanted:
        wanted["depth"] = max(1, min(int(wanted["depth"]), 8))
    return REPORTS[name](site, **wanted)


def parse_filters(query_string: str) -> dict:
    """filter_pages' parameters from a URL's query: lists by comma, blanks and what isn't a number passed over."""
    given = {k: v[0].strip() for k, v in parse_qs(query_string, keep_blank_values=True).items()}
    out: dict = {}
    for name in ("domains", "cms", "content_kinds", "schema_formats", "schema_types"):
        if listed := [x.strip() for x in given.get(name, "").split(",") if x.strip()]:
            out[name] = listed
    out |= {k: given[k] for k in ("date_from", "date_to") if given.get(k)}
    try:
        out |= {"min_coverage": float(given["min_coverage"])} if given.get("min_coverage") else {}
    except ValueError:
        pass
    return out


def parse_parameters(query_string: str) -> dict:
    """report()'s own: full, top, depth."""
    given = {k: v[0].strip().lower() for k, v in parse_qs(query_string).items()}
    out: dict = {"full": True} if given.get("full") in ("1", "true", "yes", "all") else {}
    return out | {k: int(given[k]) for k in ("top", "depth") if given.get(k, "").isdigit()}


def key(u: str) -> str:
    """SQL of the merge form of a URL."""
    path = f"regexp_replace(regexp_extract(trim({u}), '^[^/?#]*//[^/?#]*([^?#]*)', 1), '/+$', '')"
    query = f"regexp_extract(trim({u}), '^[^#?]*[?]([^#]*)', 1)"
    return f"CASE WHEN regexp_matches(trim({u}), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') THEN concat(lower(regexp_extract(trim({u}), '^([^:]*://[^/?#]*)', 1)), CASE WHEN {path} = '' THEN '/' ELSE {path} END, CASE WHEN {query} <> '' THEN concat('?', {query}) ELSE '' END) ELSE trim({u}) END"


def host(u: str) -> str:
    return f"regexp_extract(lower({u}), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)"


def integer(c: str) -> str:
    return f"(CASE WHEN regexp_full_match(trim({c}), '[+-]?[0-9]+') THEN CAST(trim({c}) AS BIGINT) ELSE 0 END)"


def real(c: str, default: str = "0.0") -> str:
    return f"coalesce(try_cast(trim({c}) AS DOUBLE), {default})"


def near(x: str, places: int = 1) -> str:
    return f"(round_even(({x}) * {10**places}.0, 0) / {10**places}.0)"


def pct(part: str, whole: str) -> str:
    return f"(CASE WHEN {whole} > 0 THEN {near(f'CAST({part} AS DOUBLE) / {whole} * 100')} ELSE 0.0 END)"


def norm_date(c: str) -> str:
    months = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"
    mail = "'^[A-Za-z]{3}, ([0-9]{1,2}) ([A-Za-z]{3}) ([0-9]{4}) [0-9:]{8}'"
    iso = f"regexp_extract(trim({c}), '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1)"
    return f"CASE WHEN {iso} <> '' THEN {iso} WHEN list_position({months}, lower(regexp_extract(trim({c}), {mail}, 2))) > 0 THEN concat_ws('-', regexp_extract(trim({c}), {mail}, 3), lpad(CAST(list_position({months}, lower(regexp_extract(trim({c}), {mail}, 2))) AS VARCHAR), 2, '0'), lpad(regexp_extract(trim({c}), {mail}, 1), 2, '0')) END"


def parts(c: str) -> str:
    return f"list_filter(list_transform(string_split({c}, '|'), lambda x: trim(x)), lambda x: x <> '')"


def newest(table: str, *keys: str, where: str = "TRUE") -> str:
    return f"SELECT * EXCLUDE (_n) FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY run DESC, seq DESC) AS _n FROM {table} WHERE {where}) t WHERE _n = 1"


MERGED = {
    "p": newest("pages_raw", key("requested_url"), where=f"{key('requested_url')} <> ''"),
    "ed": newest("edges", key("from_url"), key("to_url")),
    "tg": newest("tags", key("page_url"), "lower(trim(tag_value))"),
    "nv": newest("nav_links", key("page_url"), key("nav_href")),
    "ast": newest("assets", key("referrer_page_url"), key("asset_url"), "category"),
    "er": f"SELECT * FROM ({newest('errors', key('url'))}) e WHERE {key('e.url')} NOT IN (SELECT {key('requested_url')} FROM p WHERE try_cast(substr(trim(http_status), 1, 3) AS INT) BETWEEN 200 AND 399)",
}


def query(name: str, sql: str | None, *ctes: str):
    """Registers a query over a Site. Its SQL may use the engine's tables, their merged forms and further statements."""

    def register(function: Callable[[Site], DataFrame]):
        REPORTS[name] = function
        QUERIES[name] = lambda spark, sf_dir: function(Site(estate.load(spark, sf_dir), spark=spark, folder=sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = estate.oracle_with(*(f"{k} AS ({v})" for k, v in MERGED.items()), *ctes) + "\n" + sql
        return function

    return register
