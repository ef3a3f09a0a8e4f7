"""JSON-LD of pages as VARIANT, in expressions: scripts are found by pattern, parsed, and flattened through lists and graphs within
their row; nothing is exploded, shuffled or sent to Python.

A script that is no JSON is passed over; so is one with a key twice in an object, which VARIANT has no form for. Scripts in comments,
or written within other scripts, are none. Items come in the order of the page. A null page has none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.scalars import text

_TYPED = r"""(?=[^>]*\s(?i:type)\s*=\s*(?:"application/ld\+json"|'application/ld\+json'|application/ld\+json[\s>]))"""
#: Comments and other scripts are matched so that what they hold isn't; only the scripts in question fill the group.
SCRIPTS = rf"(?s)<!--.*?-->|<(?i:script)\b{_TYPED}[^>]*>(.*?)</(?i:script)\s*>|<(?i:script)\b.*?</(?i:script)\s*>"
LIST = "array<variant>"


def blocks(html: Column) -> Column:
    """The texts of a page's JSON-LD scripts."""
    return F.filter(F.regexp_extract_all(text(html), F.lit(SCRIPTS), F.lit(1)), lambda x: F.trim(x) != "")


def _all(blocks: Column) -> Column:
    return F.filter(F.transform(blocks, lambda x: F.try_parse_json(x)), lambda v: v.isNotNull())


def _levels(blocks: Column) -> Column:
    """How deep lists and graphs can lie in one another, at most: each level takes a graph or a list within a list."""
    joined = F.concat_ws(" ", blocks)
    return 2 + 2 * F.regexp_count(joined, F.lit('"@graph"')) + F.regexp_count(joined, F.lit(r"[\[,]\s*\["))


def items(blocks: Column) -> Column:
    """The items of parsed scripts, through lists and graphs however deep."""

    def opened(v: Column) -> Column:
        return F.coalesce(F.try_variant_get(v, "$", LIST), F.try_variant_get(v, '$["@graph"]', LIST), F.array(v))

    whole = F.aggregate(F.sequence(F.lit(1), _levels(blocks)), _all(blocks), lambda found, _: F.flatten(F.transform(found, opened)))
    # what is neither a list nor an object says nothing
    return F.filter(whole, lambda v: F.schema_of_variant(v).startswith("OBJECT"))


def cell(v: Column, path: str) -> Column:
    """The text at a path; blank for none, null and false."""
    x = F.trim(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")))
    return F.when(x == "false", "").otherwise(x)


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def texts(v: Column, path: str) -> Column:
    """The filled texts of a list, or of one text."""
    listed = F.transform(F.try_variant_get(v, path, LIST), lambda x: cell(x, "$"))
    return F.filter(F.coalesce(listed, F.array(cell(v, path))), lambda x: x != "")


def once(values: Column) -> Column:
    """The first of those that differ in case only."""
    low = F.transform(values, lambda x: F.lower(x))
    return F.filter(values, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def of_all(items: Column, take: Callable[[Column], Column]) -> Column:
    """What `take`, which gives a list, finds in all items."""
    return F.flatten(F.transform(items, take))


def first(values: Column) -> Column:
    """The first filled text."""
    return F.coalesce(F.get(F.filter(values, lambda x: x != ""), F.lit(0)), F.lit(""))


def kinds(v: Column) -> Column:
    return texts(v, '$["@type"]')


def _are(items: Column, kind: str) -> Column:
    return F.filter(items, lambda v: F.array_contains(F.transform(kinds(v), lambda k: F.lower(k)), kind))


def _named(v: Column, path: str, *inner: str) -> Column:
    """Of what may be an object or a text: a member of the object, or the text."""
    found = F.lit("")
    for name in reversed(inner):
        found = F.when(cell(v, f"{path}.{name}") != "", cell(v, f"{path}.{name}")).otherwise(found)
    return F.when(F.schema_of_variant(at(v, path)).startswith("OBJECT"), found).otherwise(cell(v, path))


def authors(v: Column) -> Column:
    one = F.array(_named(v, "$.author", "name"))
    several = F.transform(F.try_variant_get(v, "$.author", LIST), lambda a: _named(a, "$", "name"))
    return F.array_join(F.filter(F.coalesce(several, one), lambda x: x != ""), " | ")


def _parts(values: Column, name: str) -> Column:
    """Of structs, in order, the first whose first part is filled, else the last; blank without one."""
    lead = F.filter(values, lambda x: x.getField("lead") != "")
    return F.coalesce(F.get(lead, F.lit(0)).getField(name), F.get(F.reverse(values), F.lit(0)).getField(name), F.lit(""))


def offers(items: Column) -> Column:
    """lead (a price), currency, availability of products' first offers."""

    def offer(v: Column) -> Column:
        x = F.coalesce(F.get(F.try_variant_get(v, "$.offers", LIST), F.lit(0)), at(v, "$.offers"))
        price = F.when(cell(x, "$.price") != "", cell(x, "$.price")).otherwise(cell(x, "$.lowPrice"))
        there = F.coalesce(F.schema_of_variant(x), F.lit("")).startswith("OBJECT")
        return F.when(there, F.struct(price.alias("lead"), cell(x, "$.priceCurrency").alias("currency"), F.element_at(F.split(cell(x, "$.availability"), "/"), -1).alias("availability")))

    return F.filter(F.transform(_are(items, "product"), offer), lambda x: x.isNotNull())


def ratings(items: Column) -> Column:
    """lead (a rating) and count."""

    def rating(v: Column) -> Column:
        x = F.coalesce(at(v, "$.aggregateRating"), at(v, "$.review"))
        there = F.coalesce(F.schema_of_variant(x), F.lit("")).startswith("OBJECT")
        count = F.when(cell(x, "$.reviewCount") != "", cell(x, "$.reviewCount")).otherwise(cell(x, "$.ratingCount"))
        return F.when(there, F.struct(cell(x, "$.ratingValue").alias("lead"), count.alias("count")))

    return F.filter(F.transform(items, rating), lambda x: x.isNotNull())


def crumbs(items: Column) -> Column:
    """Names of the first breadcrumb list that has some, by position; those without a position come first, in order."""

    def names(v: Column) -> Column:
        entries = F.coalesce(F.try_variant_get(v, "$.itemListElement", LIST), F.array().cast(LIST))
        placed = F.transform(entries, lambda x, i: F.struct(F.coalesce(F.try_variant_get(x, "$.position", "double"), F.lit(0.0)).alias("p"), i.alias("i"), F.when(cell(x, "$.name") != "", cell(x, "$.name")).otherwise(cell(x, "$.item.name")).alias("n")))
        return F.array_join(F.transform(F.filter(F.array_sort(placed), lambda x: x.getField("n") != ""), lambda x: x.getField("n")), " > ")

    lists = F.filter(items, lambda v: F.array_contains(kinds(v), "BreadcrumbList"))
    return first(F.transform(lists, names))


def cells(df: DataFrame, html: str = "html") -> DataFrame:
    """df, without its HTML, with what its pages' JSON-LD says: a column for each cell of the inventory that can come from it."""
    rest = [c for c in df.columns if c != html]
    found = df.select(*rest, blocks(F.col(html)).alias("_b")).select(*rest, items(F.col("_b")).alias("_v"))
    v = F.col("_v")
    found = found.select(*rest, "_v", offers(v).alias("_o"), ratings(v).alias("_r"))

    def of(kind: str, take: Callable[[Column], Column]) -> Column:
        return first(F.transform(_are(v, kind), take))

    given = {
        "json_ld_types": F.array_join(once(of_all(v, kinds)), "|"),
        "json_ld_keywords": F.array_join(once(of_all(v, lambda x: texts(x, "$.keywords"))), "|"),
        "json_ld_sections": F.array_join(once(of_all(v, lambda x: F.concat(texts(x, "$.articleSection"), texts(x, "$.genre")))), "|"),
        "json_ld_id": first(F.transform(v, lambda x: cell(x, '$["@id"]'))),
        "date_published": first(F.transform(v, lambda x: cell(x, "$.datePublished"))),
        "date_modified": first(F.transform(v, lambda x: cell(x, "$.dateModified"))),
        "author": first(F.transform(v, authors)),
        "publisher": first(F.transform(v, lambda x: _named(x, "$.publisher", "name"))),
        "breadcrumb_schema": crumbs(v),
        "schema_price": _parts(F.col("_o"), "lead"),
        "schema_currency": _parts(F.col("_o"), "currency"),
        "schema_availability": _parts(F.col("_o"), "availability"),
        "schema_rating": _parts(F.col("_r"), "lead"),
        "schema_review_count": _parts(F.col("_r"), "count"),
        "schema_event_date": of("event", lambda x: cell(x, "$.startDate")),
        "schema_event_location": of("event", lambda x: F.substring(_named(x, "$.location", "name", "address"), 1, 200)),
        "schema_job_title": of("jobposting", lambda x: cell(x, "$.title")),
        "schema_job_location": of("jobposting", lambda x: _named(x, "$.jobLocation.address", "addressLocality")),
        "schema_recipe_time": of("recipe", lambda x: F.when(cell(x, "$.totalTime") != "", cell(x, "$.totalTime")).otherwise(cell(x, "$.cookTime"))),
    }
    return found.select(*rest, *(F.coalesce(x, F.lit("")).alias(name) for name, x in given.items()))
