"""The engine's functions by name, for SQL: register(spark) makes them known to a session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from gleanery.operators.extract import LISTS
from gleanery.operators.html import Page
from gleanery.session import ship_package

#: Scalar functions as SQL, which the optimiser expands in place.
SCALARS = {
    "url_host": ("u STRING", "STRING", "CASE WHEN startswith(regexp_replace(regexp_extract(lower(trim(coalesce(u, ''))), r'^(?:[a-z][a-z0-9+.-]*:)?(?://([^/?#]*))?', 1), r'^.*@', ''), '[') THEN regexp_extract(regexp_replace(regexp_extract(lower(trim(coalesce(u, ''))), r'^(?:[a-z][a-z0-9+.-]*:)?(?://([^/?#]*))?', 1), r'^.*@', ''), r'^\\[([^\\]]*)', 1) ELSE regexp_extract(regexp_replace(regexp_extract(lower(trim(coalesce(u, ''))), r'^(?:[a-z][a-z0-9+.-]*:)?(?://([^/?#]*))?', 1), r'^.*@', ''), r'^([^:]*)', 1) END"),
    "safe_int": ("c STRING", "BIGINT", "CASE WHEN trim(c) RLIKE '^[+-]?[0-9]+$' THEN coalesce(try_cast(trim(c) AS BIGINT), 0) ELSE 0 END"),
    "is_filled": ("c STRING", "BOOLEAN", "trim(coalesce(c, '')) <> ''"),
    "text_hash": ("c STRING", "STRING", "substr(sha2(CAST(coalesce(c, '') AS BINARY), 256), 1, 16)"),
}


def _table_function(name: str):
    extractor, names = LISTS[name]

    class Extracted:
        def eval(self, url: str, html: str) -> Iterator[tuple]:
            yield from extractor(Page(html, url))

    return udtf(Extracted, returnType=", ".join(f"{n} string" for n in names))


def register(spark: SparkSession) -> list[str]:
    """Scalar functions url_host, safe_int, is_filled and text_hash; table functions page_edges, page_nav, page_tags, page_phones and
    page_assets of (url, html). Returns their names."""
    ship_package(spark)
    for name, (takes, gives, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    for name in LISTS:
        spark.udtf.register(f"page_{name}", _table_function(name))
    return [*SCALARS, *(f"page_{n}" for n in LISTS)]
