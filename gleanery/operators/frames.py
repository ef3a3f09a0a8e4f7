"""Operators on frames that reports are composed of."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions import urls
from gleanery.functions.scalars import as_float, filled, parts, text
from gleanery.session import shared_folder


#: What the tables are merged by: columns, and the forms that are compared.
KEYS: dict[str, tuple[Callable[[], Column], ...]] = {
    "pages": (lambda: urls.url_key("requested_url"),),
    "edges": (lambda: urls.url_key("from_url"), lambda: urls.url_key("to_url")),
    "tags": (lambda: urls.url_key("page_url"), lambda: F.lower(F.trim(text("tag_value")))),
    "nav": (lambda: urls.url_key("page_url"), lambda: urls.url_key("nav_href")),
    "assets": (lambda: urls.url_key("referrer_page_url"), lambda: urls.url_key("asset_url"), lambda: F.col("category")),
    "errors": (lambda: urls.url_key("url"),),
}


def key_names(kind: str) -> list[str]:
    return [f"_key{i}" for i in range(len(KEYS[kind]))]


def keyed(df: DataFrame, kind: str) -> DataFrame:
    """df with the columns that it is merged by; as it is, if it has them, as a clustered table does."""
    names = key_names(kind)
    return df if names[0] in df.columns else df.withColumns(dict(zip(names, (k() for k in KEYS[kind]), strict=True)))


def merge_runs(df: DataFrame, kind: str, runs: int) -> DataFrame:
    """The newest row of each key: of the last run, and the last within it. With one run nothing is merged, and rows with a
    blank key stay, as they don't with more. The window keeps one row for each key and task before the shuffle; over a table
    that is clustered by the key there is none."""
    names = key_names(kind)
    if runs < 2:
        return df.drop(*names)
    rows = keyed(df, kind).where(F.col(names[0]) != "")
    newest = F.row_number().over(Window.partitionBy(*names).orderBy(F.desc("run"), F.desc("seq")))
    return rows.withColumn("_n", newest).where("_n = 1").drop("_n", *names)


def merge_pages(df: DataFrame, runs: int = 2) -> DataFrame:
    return merge_runs(df, "pages", runs)


def merge_edges(df: DataFrame, runs: int = 2) -> DataFrame:
    return merge_runs(df, "edges", runs)


def merge_tags(df: DataFrame, runs: int = 2) -> DataFrame:
    return merge_runs(df, "tags", runs)


def merge_nav(df: DataFrame, runs: int = 2) -> DataFrame:
    return merge_runs(df, "nav", runs)


def merge_assets(df: DataFrame, runs: int = 2) -> DataFrame:
    return merge_runs(df, "assets", runs)


def succeeded(status) -> Column:
    code = F.substring(F.trim(text(status)), 1, 3).try_cast("int")
    return F.coalesce((code >= 200) & (code < 400), F.lit(False))


def without_succeeded(errors: DataFrame, pages: DataFrame) -> DataFrame:
    """Errors but those of URLs that a page row shows to have succeeded."""
    fine = pages.where(succeeded("http_status")).select(urls.url_key("requested_url").alias("_ok")).distinct()
    return errors.join(fine, urls.url_key(errors["url"]) == fine["_ok"], "left_anti")


def merge_errors(df: DataFrame, pages: DataFrame, runs: int = 2) -> DataFrame:
    """Errors of URLs that a page row shows to have succeeded go, with one run too."""
    return without_succeeded(merge_runs(df, "errors", runs), pages)


def filter_pages(
    df: DataFrame,
    domains: Sequence[str] = (),
    cms: Sequence[str] = (),
    content_kinds: Sequence[str] = (),
    schema_formats: Sequence[str] = (),
    schema_types: Sequence[str] = (),
    date_from: str = "",
    date_to: str = "",
    min_coverage: float | None = None,
) -> DataFrame:
    """Every given dimension must hold; after a merge, never before it: a newer row that fails still hides the older."""
    low = lambda c: F.lower(text(c))
    tests = []
    if domains:
        tests.append(low("domain").isin(*(d.lower() for d in domains)))
    if cms:
        tests.append(_either(F.contains(low("cms_generator"), F.lit(c.lower())) for c in cms))
    if content_kinds:
        tests.append(F.trim(low("content_kind_guess")).isin(*(k.lower() for k in content_kinds)))
    if schema_formats:
        columns = {"json_ld": "json_ld_types", "microdata": "microdata_types", "rdfa": "rdfa_types"}
        tests.append(_either(filled(columns[f]) for f in schema_formats if f in columns))
    if schema_types:
        joined = F.lower(F.concat_ws("|", text("json_ld_types"), text("microdata_types"), text("rdfa_types")))
        tests.append(_either(F.contains(joined, F.lit(t.lower())) for t in schema_types))
    published, modified = F.trim(text("date_published")), F.trim(text("date_modified"))
    if date_from:
        tests.append((published >= date_from) | (modified >= date_from))
    if date_to:
        # a blank date is below any other
        tests.append((F.substring(published, 1, 10) <= date_to) | (F.substring(modified, 1, 10) <= date_to))
    if min_coverage is not None:
        tests.append(as_float("extraction_coverage_pct") >= min_coverage)
    for t in tests:
        df = df.where(t)
    return df


def _either(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def page_urls(pages: DataFrame) -> DataFrame:
    """The URLs that rows of other tables may name pages by."""
    return pages.select(F.explode(F.array("final_url", "requested_url")).alias("u")).where("u <> ''").distinct()


def restrict(df: DataFrame, column: str, pages: DataFrame) -> DataFrame:
    """Rows of the pages given; all rows if there are no pages, which a look at one page decides."""
    if pages.isEmpty():
        return df
    return df.join(page_urls(pages).select(F.col("u").alias("_u")), F.col(column) == F.col("_u"), "left_semi")


def top(df: DataFrame, n: int, by: str, *tie: str, per: str | None = None) -> DataFrame:
    """The n greatest, ties in the order of the tie columns; of each group with `per`."""
    order = [F.desc(by), *tie]
    if per is None:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(per).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def capped(df: DataFrame, n: int | None) -> DataFrame:
    """The first n rows of an ordered frame; all, and in no order, if n is None."""
    return df if n is None else df.limit(n)


def counts(df: DataFrame, *by, name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias(name))


def looked_up(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, share: int = 1000) -> DataFrame:
    """rows joined with the other columns of `table`, which has one row for each of the keys, none of them null, and in `weight` how
    many of the rows have it. Keys of more than one in `share` rows, so fewer than that many, are broadcast and their rows stay where
    they are; the others, none of which is hot, are shuffled. The table should be a written one: it is read more than once."""
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    named = table.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in table.columns if c not in keys))
    same = reduce(and_, (F.col(k) == F.col(f"_{k}") for k in keys))
    hot, few = named.where(F.col(weight) * share > total), named.where(F.col(weight) * share <= total)
    rest = rows.join(F.broadcast(hot.select(*(f"_{k}" for k in keys))), same, "left_anti")
    both = rows.join(F.broadcast(hot), same).unionByName(rest.join(few.hint("shuffle_merge"), same))
    return both.drop(*(f"_{k}" for k in keys))


#: Values of a group that are sorted in one task at most, and the bins that a round parts a group's values into.
HELD, BINS = 50_000, 512


def written(df: DataFrame) -> DataFrame:
    """df as files in the shared folder, read back: what is read more than once, or must not change when tasks are run again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def selected(df: DataFrame, value: str, per: str, rank: Callable[[Column], Column], name: str, times: str | None = None, held: int = HELD, bins: int = BINS) -> DataFrame:
    """per, `name`: the value at a place of each group's sorted values, from 0, where `rank` gives the place by their number; a row
    stands for as many values as `times` says, if that is given. Rounds of histograms, which tasks combine before the shuffle, narrow
    the span in which each group's value lies, until it is one value or has `held` rows at most; only those are sorted. So no list
    and no window holds a group. Nulls take no part; a null group's rows neither."""
    weight = F.lit(1).cast("long") if times is None else F.col(times).cast("long")
    rows = df.select(F.col(per).alias("_g"), F.col(value).alias("_v"), weight.alias("_t")).where("_g is not null and _v is not null and _t > 0")
    spans = written(rows.groupBy("_g").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), rank(F.sum("_t")).cast("long").alias("_k")))
    if not _narrow(spans, held):
        rows = written(rows)
    while not _narrow(spans, held):
        inside = looked_up(rows, spans.where("_lo < _hi"), ["_g"], "_n").where("_v between _lo and _hi")
        counted = inside.groupBy("_g", _bin(bins).alias("_b")).agg(F.sum("_t").alias("_c"), F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.first("_k").alias("_k"))
        # `bins` rows of a group at most
        hit = counted.withColumn("_u", F.sum("_c").over(Window.partitionBy("_g").orderBy("_b"))).where("_k < _u and _k >= _u - _c")
        spans = written(hit.select("_g", "_n", "_lo", "_hi", (F.col("_k") - F.col("_u") + F.col("_c")).alias("_k")).unionByName(spans.where("_lo >= _hi")))
    left = looked_up(rows, spans.where("_lo < _hi"), ["_g"], "_n").where("_v between _lo and _hi")
    by_value = left.groupBy("_g", "_v").agg(F.sum("_t").alias("_c"), F.first("_k").alias("_k"))
    placed = by_value.withColumn("_u", F.sum("_c").over(Window.partitionBy("_g").orderBy("_v")))
    found = placed.where("_k < _u and _k >= _u - _c").select("_g", "_v").unionByName(spans.where("_lo >= _hi").select("_g", F.col("_lo").alias("_v")))
    return found.select(F.col("_g").alias(per), F.col("_v").alias(name))


def _narrow(spans: DataFrame, held: int) -> bool:
    return spans.where((F.col("_lo") < F.col("_hi")) & (F.col("_n") > held)).isEmpty()


def _bin(bins: int) -> Column:
    """A bin of a value within its span: by its logarithm while the span is wide, so that a few rounds narrow any span of doubles.
    Only the order of bins matters, not where exactly they part."""
    v, lo, hi = (F.col(c).cast("double") for c in ("_v", "_lo", "_hi"))
    logarithm = lambda x: F.signum(x) * F.log1p(F.abs(x))
    wide = (hi - lo) > F.greatest(F.abs(lo), F.abs(hi)) / 2 + 1
    part = lambda x, a, b: F.floor((x - a) / (b - a) * bins)
    return F.when(wide, part(logarithm(v), logarithm(lo), logarithm(hi))).otherwise(part(v, lo, hi))


def nearest_ranks(df: DataFrame, value: str, tenths: int, per: str) -> DataFrame:
    """per, p<tenths>0: the value at floor(tenths / 10 * (n - 1)) of each group's sorted values."""
    return selected(df, value, per, lambda n: F.floor((n - 1) * tenths / 10), f"p{tenths}0")


def ranked(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with each row's place, from 0, in the order of a column without repeats. Rows are dealt by ranges of it and counted
    within their partitions; what lies before a partition is added, of which one row for each is gathered."""
    dealt = df.repartitionByRange(by).withColumn("_p", F.spark_partition_id())
    # written once: ranges are cut from a sample, which another run might draw otherwise
    dealt = written(dealt)
    before = counts(dealt, "_p", name="_n").withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(by)) - 1
    return dealt.withColumn("_w", within).join(F.broadcast(before.select("_p", "_before")), "_p").withColumn(name, (F.col("_before") + F.col("_w")).cast("long")).drop("_p", "_w", "_before")


def exploded(df: DataFrame, column: str, name: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(parts(column)).alias(name))


def page(df: DataFrame, number: int, size: int, *order: str) -> DataFrame:
    """A page of rows, from 1."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def pick_diverse(df: DataFrame, n: int, url: str = "url") -> DataFrame:
    """n rows in turn from each first path segment. No more than n rows of a segment are ranked, and each task keeps as many
    before the shuffle; where a segment was first seen is an aggregate."""
    segment = F.element_at(F.split(F.concat(urls.path(url), F.lit("/")), "/"), 2)
    dealt = df.withColumn("segment", segment)
    turns = dealt.withColumn("turn", F.row_number().over(Window.partitionBy("segment").orderBy("seq"))).where(F.col("turn") <= n)
    seen = dealt.groupBy("segment").agg(F.min("seq").alias("seen"))
    return turns.join(seen, "segment").orderBy("turn", "seen", "seq").limit(n)


def reachable(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Breadth-first: url and its least number of links from a seed, up to `depth`. Each level is checkpointed in the shared
    folder, so that plans don't grow with the depth and lost executors cost one level; links are read and made unlike once."""
    links = written(edges.select("from_url", "to_url").where("from_url <> to_url").distinct())
    found = written(seeds.select(F.col("url"), F.lit(0).alias("depth")).distinct())
    frontier = found
    for level in range(1, depth + 1):
        new = frontier.join(links, frontier["url"] == links["from_url"]).select(F.col("to_url").alias("url")).distinct()
        frontier = written(new.join(found.select("url"), "url", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found
