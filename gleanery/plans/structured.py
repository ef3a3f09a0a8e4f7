"""What pages say in JSON-LD, over pages that carry it: the raw ones have none, so scripts by their ids are added to their HTML, by a
statement that both engines run. The SQL that the queries are held against reads those scripts with the other engine's own JSON
functions and walks them by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gleanery.operators import jsonld
from gleanery.plans.registry import Site, query

_I = "CAST(page_id AS STRING)"


def _script(*parts: str, attributes: str = 'type="application/ld+json"') -> str:
    """SQL of a script; parts in braces are expressions."""
    shown = [x if x.startswith("CAST") else "'" + x.replace("'", "''") + "'" for x in parts]
    return f"concat('<script {attributes}>', {', '.join(shown)}, '</script>')".replace("'<script " + attributes, "'<script " + attributes.replace("'", "''"))


_SCRIPTS = {
    0: _script('{"@context": "https://schema.org", "@graph": [{"@type": "Product", "@id": "#p', _I, '", "offers": [{"price": ', _I, '.5, "priceCurrency": "EUR", "availability": "https://schema.org/InStock"}, {"price": 1}], "aggregateRating": {"ratingValue": "4.5", "ratingCount": ', _I, '}, "keywords": ["Kettle ', _I, '", " hot ", "HOT"]}, {"@type": ["Article", "article"], "datePublished": "2024-01-02", "author": [{"name": "Ann"}, "Bo"], "publisher": {"name": "Press ', _I, '"}, "keywords": "kettle, hot", "genre": ["Home", "home"]}]}'),
    1: _script('[{"@type": "Event", "startDate": "2024-06-01", "location": {"address": "Main St ', _I, '"}}, {"@graph": [{"@type": "JobPosting", "title": "Nurse ', _I, '", "jobLocation": {"address": {"addressLocality": "Leeds"}}}, [{"@type": "Recipe", "cookTime": "PT5M"}]]}]'),
    2: "concat(" + _script("{broken ", _I) + ", " + _script('{"@type": "WebPage", "@id": "', _I, '", "dateModified": "2023-05-06", "author": {"name": "Cy"}}') + ")",
    3: _script('{"@type": "BreadcrumbList", "itemListElement": [{"position": 2, "name": "News ', _I, '"}, {"position": 1, "item": {"name": "Start"}}]}', attributes="id=x type='application/ld+json'"),
    4: _script('var x = [{"@type": "No"}]; // ', _I, attributes='type="text/javascript"'),
    5: "concat(" + _script('{"@type": "NewsArticle", "articleSection": "Sport", "author": "Di", "offers": {"price": 9}}') + ", " + _script('{"@type": ["newsarticle", "Product"], "offers": {"lowPrice": ', _I, ', "availability": "SoldOut"}, "keywords": ["sport", "Tea"], "genre": "tea"}') + ")",
    6: _script('[[{"@type": "Thing", "review": {"ratingValue": ', _I, ', "reviewCount": 1}}], {"@graph": [{"@graph": [{"@type": "Deep"}, {"@graph": {"@type": "Shown"}, "@type": "Holder"}]}]}, 7, "text"]'),
    7: _script('{"@type": null, "keywords": [1, null, "two ', _I, '"], "@id": false, "publisher": "Own"}'),
}
_HTML = f"concat(html, CASE page_id % 8 {' '.join(f'WHEN {n} THEN {x}' for n, x in _SCRIPTS.items())} END)"


def described(s: Site) -> DataFrame:
    return s.spread_table("pages").selectExpr("page_id", f"{_HTML} AS html")


# Items of all scripts that are JSON, by recursion through lists and graphs, with the place of each.
_STEP = "SELECT page_id, unnest(range(len(a))) AS i, o, a FROM (SELECT page_id, o, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') WHEN json_type(j, '$.\"@graph\"') = 'ARRAY' THEN json_extract(j, '$.\"@graph\"[*]') END AS a FROM walk)"
_ITEMS = f"""SELECT page_id, o, j FROM (WITH RECURSIVE walk AS (SELECT page_id, [n] AS o, CAST(t AS JSON) AS j FROM (SELECT page_id, unnest(range(len(x))) AS n, unnest(x) AS t FROM (SELECT page_id, regexp_extract_all(html, '<script [^>]*type=["'']application/ld[+]json["''][^>]*>(.*?)</script>', 1, 's') AS x FROM ld)) WHERE json_valid(t)
UNION ALL SELECT page_id, list_append(o, i), a[i + 1] FROM ({_STEP}))
SELECT * FROM walk) WHERE json_type(j) = 'OBJECT' AND coalesce(json_type(j, '$."@graph"'), '') <> 'ARRAY'"""
_CTES = (f"ld AS (SELECT page_id, {_HTML} AS html FROM pages)", f"it AS ({_ITEMS})")


def _text(path: str, j: str = "j") -> str:
    return f"(CASE WHEN json_type({j}, '{path}') IN ('NULL', 'ARRAY') THEN '' ELSE trim(coalesce(json_extract_string({j}, '{path}'), '')) END)"


def _texts(path: str) -> str:
    return f"list_filter(CASE WHEN json_type(j, '{path}') = 'ARRAY' THEN list_transform(json_extract_string(j, '{path}[*]'), lambda x: trim(coalesce(x, ''))) ELSE [{_text(path)}] END, lambda x: x NOT IN ('', 'null'))"


def _first(value: str, where: str = "TRUE") -> str:
    return f"coalesce(first({value} ORDER BY o) FILTER ({where} AND {value} <> ''), '')"


def _is(kind: str) -> str:
    return f"list_contains(list_transform({_texts('$."@type"')}, lambda x: lower(x)), '{kind}')"


def _listed(path: str, *more: str) -> str:
    """The first of those that differ in case only, in order, piped."""
    values = f"list_concat({_texts(path)}, {_texts(more[0])})" if more else _texts(path)
    return f"SELECT page_id, string_agg(t, '|' ORDER BY o, k) AS v FROM (SELECT *, row_number() OVER (PARTITION BY page_id, lower(t) ORDER BY o, k) AS r FROM (SELECT page_id, o, unnest(range(len(x))) AS k, unnest(x) AS t FROM (SELECT page_id, o, {values} AS x FROM it))) WHERE r = 1 GROUP BY page_id"


@query("json_ld_types", f"""SELECT ld.page_id, coalesce(v, '') AS json_ld_types FROM ld LEFT JOIN ({_listed('$."@type"')}) t ON t.page_id = ld.page_id""", *_CTES)
def json_ld_types(s: Site) -> DataFrame:
    """Types of a page's items, the first of those that differ in case only."""
    return jsonld.cells(described(s)).select("page_id", "json_ld_types")


@query("json_ld_keywords", f"SELECT ld.page_id, coalesce(k.v, '') AS json_ld_keywords, coalesce(t.v, '') AS json_ld_sections FROM ld LEFT JOIN ({_listed('$.keywords')}) k ON k.page_id = ld.page_id LEFT JOIN ({_listed('$.articleSection', '$.genre')}) t ON t.page_id = ld.page_id", *_CTES)
def json_ld_keywords(s: Site) -> DataFrame:
    return jsonld.cells(described(s)).select("page_id", "json_ld_keywords", "json_ld_sections")


_NAMES = "CASE WHEN json_type(j, '$.author') = 'ARRAY' THEN array_to_string(list_filter(list_transform(json_extract(j, '$.author[*]'), lambda x: coalesce(json_extract_string(x, '$.name'), CASE WHEN json_type(x) = 'VARCHAR' THEN json_extract_string(x, '$') END)), lambda x: x IS NOT NULL), ' | ') WHEN json_type(j, '$.author') = 'OBJECT' THEN " + _text("$.author.name") + " ELSE " + _text("$.author") + " END"


@query(
    "json_ld_people",
    f"""SELECT ld.page_id, {_first(_text('$."@id"'), f"{_text('$."@id"')} <> 'false'")} AS json_ld_id, {_first(_text('$.datePublished'))} AS date_published, {_first(_text('$.dateModified'))} AS date_modified, {_first(f'({_NAMES})')} AS author, {_first(f"(CASE WHEN json_type(j, '$.publisher') = 'OBJECT' THEN {_text('$.publisher.name')} ELSE {_text('$.publisher')} END)")} AS publisher FROM ld LEFT JOIN it ON it.page_id = ld.page_id GROUP BY ld.page_id""",
    *_CTES,
)
def json_ld_people(s: Site) -> DataFrame:
    """Who made a page and when, and its name."""
    return jsonld.cells(described(s)).select("page_id", "json_ld_id", "date_published", "date_modified", "author", "publisher")


_CRUMBS = "array_to_string(list_transform(list_sort(list_transform(json_extract(j, '$.itemListElement[*]'), lambda x: {'p': CAST(json_extract(x, '$.position') AS INT), 'n': coalesce(json_extract_string(x, '$.name'), json_extract_string(x, '$.item.name'))})), lambda x: x.n), ' > ')"
#: Of what an item offers: an offer, or the first of a list.
_OFFER = "CASE WHEN json_type(j, '$.offers') = 'ARRAY' THEN json_extract(j, '$.offers[0]') ELSE json_extract(j, '$.offers') END"
_RATING = "coalesce(json_extract(j, '$.aggregateRating'), json_extract(j, '$.review'))"


@query(
    "schema_family",
    f"""SELECT ld.page_id, {_first(_CRUMBS, _is('breadcrumblist'))} AS breadcrumb_schema,
{_first(f"(SELECT coalesce(json_extract_string(x, '$.price'), json_extract_string(x, '$.lowPrice'), '') FROM (SELECT {_OFFER} AS x))", _is('product'))} AS schema_price, {_first(f"(SELECT coalesce(json_extract_string(x, '$.priceCurrency'), '') FROM (SELECT {_OFFER} AS x))", _is('product'))} AS schema_currency,
{_first(f"(SELECT regexp_extract(coalesce(json_extract_string(x, '$.availability'), ''), '([^/]*)$', 1) FROM (SELECT {_OFFER} AS x))", _is('product'))} AS schema_availability,
{_first(f"(SELECT coalesce(json_extract_string(x, '$.ratingValue'), '') FROM (SELECT {_RATING} AS x))")} AS schema_rating, {_first(f"(SELECT coalesce(json_extract_string(x, '$.reviewCount'), json_extract_string(x, '$.ratingCount'), '') FROM (SELECT {_RATING} AS x))")} AS schema_review_count,
{_first(_text('$.startDate'), _is('event'))} AS schema_event_date, {_first(_text('$.location.address'), _is('event'))} AS schema_event_location, {_first(_text('$.title'), _is('jobposting'))} AS schema_job_title, {_first(_text('$.jobLocation.address.addressLocality'), _is('jobposting'))} AS schema_job_location, {_first(_text('$.cookTime'), _is('recipe'))} AS schema_recipe_time
FROM ld LEFT JOIN it ON it.page_id = ld.page_id GROUP BY ld.page_id""",
    *_CTES,
)
def schema_family(s: Site) -> DataFrame:
    """Breadcrumbs, products, ratings, events, jobs and recipes."""
    rows = jsonld.cells(described(s))
    return rows.select("page_id", "breadcrumb_schema", *(c for c in rows.columns if c.startswith("schema_")))
