"""Pages parsed once, on the executors; everything else is selected or exploded from the parsed struct."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions import rules, urls
from gleanery.functions.scalars import content_hash, rounded, text
from gleanery.operators.html import RARE, Page

FIELDS = list(Page("", "").row())
#: Lists that parse() can give, by the names of their items' parts.
LISTS: dict[str, tuple[Callable[[Page], list], tuple[str, ...]]] = {
    "edges": (Page.edges, ("to_url", "link_text")),
    "nav": (Page.nav_links, ("nav_href", "nav_text")),
    "tags": (Page.tags, ("tag_value", "tag_source")),
    "phones": (Page.phones, ("raw_href", "phone_number", "link_text")),
    "assets": (Page.assets, ("asset_url", "link_text", "category")),
}
#: Pages that are held as trees at a time.
SLICE = 32

#: Cells that coverage leaves out: identifiers, transport, and what isn't extracted.
UNCOVERED = ("http_last_modified", "etag", "has_viewport_meta", "breadcrumb_text", "body_classes", "visible_text")


def _sliced(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, rows.num_rows, SLICE):
        yield rows.slice(at, SLICE)


def _pages(rows: pa.RecordBatch, url: str, html: str, headers: str | None) -> list[Page]:
    given = [dict(h or ()) for h in rows.column(headers).to_pylist()] if headers else [None] * rows.num_rows
    return [Page(h, u, g) for h, u, g in zip(rows.column(html).to_pylist(), rows.column(url).to_pylist(), given, strict=True)]


def parse(captures: DataFrame, *parts: str, url: str = "url", html: str = "html", headers: str | None = None) -> DataFrame:
    """captures, without its HTML, with a column for each inventory field and for each list of LISTS; of `parts` only, where
    some are named (`row` stands for the fields): what isn't asked for isn't extracted. Response headers, if a column of maps is
    named, take part."""
    wanted = parts or ("row", *LISTS)
    lists = [n for n in LISTS if n in wanted]
    fields = FIELDS if "row" in wanted else []
    if fields:
        captures = captures.withColumn("analytics_signals", rules.tokens_found(html, rules.ANALYTICS))
    keep = [c for c in captures.columns if c not in (html, headers)]
    kept = ", ".join(f"`{c}` {k}" for c, k in captures.dtypes if c in keep)
    items = {n: ", ".join(f"{x}:string" for x in LISTS[n][1]) for n in lists}
    schema = ", ".join(filter(None, [kept, *(f"`{f}` string" for f in fields), *(f"`{n}` array<struct<{k}>>" for n, k in items.items())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (part for b in batches for part in _sliced(b)):
            pages = _pages(rows, url, html, headers)
            columns = [rows.column(c) for c in keep]
            if fields:
                cells = [p.row() for p in pages]
                columns += [pa.array([r[f] for r in cells], pa.string()) for f in fields]
            for n in lists:
                extractor, names = LISTS[n]
                kind = pa.list_(pa.struct([(x, pa.string()) for x in names]))
                columns.append(pa.array([[dict(zip(names, x, strict=True)) for x in extractor(p)] for p in pages], kind))
            yield pa.RecordBatch.from_arrays(columns, [*keep, *fields, *lists])

    return captures.mapInArrow(run, schema)


def signals(captures: DataFrame, url: str = "url", html: str = "html", headers: str | None = None) -> DataFrame:
    """A row of signals for each page; headers, if a column of maps is named, come too."""
    names = list(Page("", "").signals())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (part for b in batches for part in _sliced(b)):
            cells = [p.signals() for p in _pages(rows, url, html, headers)]
            yield pa.RecordBatch.from_arrays([pa.array([c[n] for c in cells], pa.string()) for n in names], names)

    return captures.select(url, html, *([headers] if headers else [])).mapInArrow(run, ", ".join(f"{n} string" for n in names))


def robots_rules(robots: DataFrame) -> DataFrame:
    """origin, group, agents (in lower case, of the group), allow, path and place of each rule of robots files (origin, txt). A group
    begins with agents, and with a blank line, or agents after rules, another; rules before any agent are none. A rule to deny nothing
    allows all. Delays are rules of a null path: they fit nothing, but show that there is a group."""
    line = F.trim(F.regexp_replace(F.col("_l"), "#.*$", ""))
    lines = robots.select("origin", F.posexplode(F.split(F.coalesce("txt", F.lit("")), r"\r\n|\r|\n")).alias("place", "_l")).select("origin", "place", (F.col("_l") == "").alias("_blank"), line.alias("_l"))
    name, value = F.lower(F.trim(F.regexp_extract("_l", "^([^:]*):", 1))), F.trim(F.regexp_extract("_l", "^[^:]*:(.*)$", 1))
    known = lines.select("origin", "place", "_blank", name.alias("_n"), value.alias("_v")).where("_blank or _n in ('user-agent', 'allow', 'disallow', 'crawl-delay', 'request-rate')")
    # lines of a file, in order: a file is one row's text, so its window is as bounded as that
    order = Window.partitionBy("origin").orderBy("place")
    starts = (F.col("_n") == "user-agent") & ~F.lag("_n", 1, "").over(order).isin("user-agent")
    grouped = known.withColumn("_s", F.when(F.col("_blank"), "").otherwise(F.col("_n"))).withColumn("_g", F.sum(F.when(F.col("_blank") | starts, 1).otherwise(0)).over(order))
    agents = F.collect_list(F.when(F.col("_n") == "user-agent", F.lower("_v"))).over(Window.partitionBy("origin", "_g"))
    rules_ = grouped.withColumn("agents", agents).where("not _blank and _n <> 'user-agent' and size(agents) > 0")
    path = F.when(F.col("_n").isin("allow", "disallow"), urls.unquoted(F.col("_v")))
    return rules_.select("origin", F.col("_g").alias("group"), "agents", ((F.col("_n") == "allow") | (path == "")).alias("allow"), path.alias("path"), "place")


def robots_allowed(targets: DataFrame, robots: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """targets with `allowed` and the longest rule that denies. robots has origin and txt, one row for each origin; origins
    without one allow everything. The rules of the first group that names the agent, else of the first for all, count, and of these
    the first that fits the path. An origin's rules are one row of the join, in the JVM; its targets, if they are very many, are split
    by adaptive execution."""
    me = agent.partition("/")[0].lower()
    found = robots_rules(robots)
    # a group that names all agents comes last, whomever else it names
    ranked = found.withColumn("_c", F.when(F.array_contains("agents", "*"), 1).when(F.exists("agents", lambda a: F.contains(F.lit(me), a)), 0)).where("_c is not null")
    first = ranked.groupBy("origin").agg(F.min(F.struct("_c", "group")).alias("_f"))
    best = ranked.join(first, "origin").where("group = _f.group")
    listed = best.groupBy(F.col("origin").alias("_o")).agg(F.array_sort(F.collect_list(F.struct("place", "allow", "path"))).alias("_r"))
    way = urls.unquoted(F.concat(F.when(urls.path(url) == "", "/").otherwise(urls.path(url)), F.when(urls.query(url) != "", F.concat(F.lit("?"), urls.query(url))).otherwise("")))
    joined = targets.withColumn("_p", urls.origin(url)).withColumn("_w", way).join(listed.hint("shuffle_merge"), F.col("_p") == F.col("_o"), "left")
    fits = F.filter("_r", lambda r: F.col("_w").startswith(r["path"]))
    judged = joined.withColumn("_fit", fits).withColumn("allowed", F.coalesce(F.get("_fit", F.lit(0))["allow"], F.lit(True)))
    denied = F.transform(F.array_sort(F.transform(F.filter("_fit", lambda r: ~r["allow"]), lambda r: F.struct((-F.length(r["path"])).alias("n"), r["place"].alias("i"), r["path"].alias("p")))), lambda x: x["p"])
    return judged.select(*targets.columns, "allowed", F.when(F.col("allowed"), "").otherwise(F.coalesce(F.get(denied, F.lit(0)), F.lit(""))).alias("rule"))


def page_rows(parsed: DataFrame, url: str = "url", training: Sequence[str] = rules.TRAINING) -> DataFrame:
    """The pages table's rows: parsed cells and what follows from them natively."""
    rows = parsed.drop(*LISTS)
    hints = rules.path_hints(url)
    kind = rules.content_kind(hints, F.col("json_ld_types"), F.col("og_type"), urls.path(url), F.col("breadcrumb_text"), F.col("body_classes"))
    rows = rows.withColumns(
        {
            "domain": urls.netloc(url),
            "url_content_hint": hints,
            "content_kind_guess": kind,
            "training_related_flag": rules.tokens_found(F.concat_ws(" ", F.col(url), "title", "h1_joined"), training),
            "content_hash": content_hash("visible_text"),
            "readability_fk_grade": F.coalesce(rules.readability("visible_text").cast("string"), F.lit("")),
        }
    )
    covered = [f for f in FIELDS if f not in UNCOVERED] + ["analytics_signals", "url_content_hint", "content_kind_guess", "training_related_flag", "readability_fk_grade"]
    rows = rows.withColumn("extraction_coverage_pct", coverage(covered))
    # the share of all cells counts among the core ones
    return rows.withColumn("extraction_coverage_core_pct", coverage([c for c in covered if c not in RARE] + ["extraction_coverage_pct"])).drop("breadcrumb_text", "body_classes")


def coverage(columns: Sequence[str]) -> Column:
    """The percentage of cells that are neither blank nor 0, as text."""
    filled_in = sum((F.when(text(c).isin("", "0"), 0).otherwise(1) for c in columns), F.lit(0))
    return rounded(filled_in / len(columns) * 100).cast("string")


def _rows(parsed: DataFrame, name: str, url: str, as_: str) -> DataFrame:
    return parsed.select(F.col(url).alias(as_), F.explode(name).alias("x")).select(as_, "x.*")


def edges(parsed: DataFrame, url: str = "url", allow: Sequence[str] = ()) -> DataFrame:
    """Links of pages to hosts in scope; all, if no domains are given."""
    return _rows(parsed, "edges", url, "from_url").where(urls.in_scope("to_url", allow))


def nav_links(parsed: DataFrame, url: str = "url") -> DataFrame:
    return _rows(parsed, "nav", url, "page_url")


def tags(parsed: DataFrame, url: str = "url") -> DataFrame:
    return _rows(parsed, "tags", url, "page_url")


def phones(parsed: DataFrame, url: str = "url") -> DataFrame:
    return _rows(parsed, "phones", url, "page_url")


def inline_assets(parsed: DataFrame, url: str = "url") -> DataFrame:
    return _rows(parsed, "assets", url, "referrer_page_url")


def linked_assets(parsed: DataFrame, url: str = "url", allow: Sequence[str] = ()) -> DataFrame:
    """Links that lead to files."""
    rows = edges(parsed, url, allow).where(urls.extension("to_url") != "")
    return rows.select(F.col("from_url").alias("referrer_page_url"), F.col("to_url").alias("asset_url"), "link_text", F.coalesce(urls.asset_category("to_url"), F.lit("other")).alias("category"))


def assets(parsed: DataFrame, url: str = "url", allow: Sequence[str] = ()) -> DataFrame:
    """Linked and embedded; one row for each page, address and category."""
    both = linked_assets(parsed, url, allow).unionByName(inline_assets(parsed, url))
    return both.groupBy("referrer_page_url", "asset_url", "category").agg(F.max("link_text").alias("link_text"))


def keyword_terms(terms: Sequence[str | None]) -> list[str]:
    """Stripped, without blanks and repeats."""
    return list(dict.fromkeys(t for x in terms if (t := (x or "").strip())))


def keyword_log(pages: DataFrame, terms: Sequence[str | None], column: str, *keep: str) -> DataFrame:
    """Hits of literal terms, whatever the case and the white space between words. The terms are part of the plan; a text is
    brought to its form once, whatever their number."""
    known = keyword_terms(terms)
    # single spaces are by far the commonest white space, and are left as they are
    form = lambda x: F.lower(F.trim(F.regexp_replace(text(x), "[\\s&&[^ ]]\\s*| \\s+", " ")))
    if not known:
        return pages.select(*keep, F.lit("").alias("term"), F.lit(0).cast("long").alias("match_count")).where("false")
    listed = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(" ".join(t.split()).lower()).alias("form")) for t in known))
    here = F.filter(listed, lambda t: F.contains(F.col("_text"), t["form"]))
    hits = pages.select(*keep, form(column).alias("_text")).select(*keep, "_text", F.explode(here).alias("t"))
    without = F.length(F.replace(F.col("_text"), F.col("t.form"), F.lit("")))
    return hits.select(*keep, "t.term", ((F.length("_text") - without) / F.length("t.form")).cast("long").alias("match_count"))


def content_duplicates(df: DataFrame, text: str, order: str) -> DataFrame:
    """Each row with its hash and whether an earlier row has it too. The earliest of each hash is an aggregate, combined
    before the shuffle, so a text with very many copies is no hot window."""
    hashed = df.withColumn("hash", content_hash(text))
    first = hashed.groupBy("hash").agg(F.min(order).alias("_first"))
    return hashed.join(first, "hash").withColumn("duplicate", F.col(order) > F.col("_first")).drop("_first")
