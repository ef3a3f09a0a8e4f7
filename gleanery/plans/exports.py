"""Reports as files: each a folder of CSV or JSON parts that the executors write; one nested document; a ZIP of CSVs."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterable

from gleanery.plans import catalogue  # noqa: F401  so that reports are registered
from gleanery.plans.registry import Site, report
from gleanery.sources.tables import write_csv

#: Reports that make up each export.
BUNDLES = {
    "content": ("content_performance_summary", "thin_content_report", "dup_hash_clusters", "dup_hash_urls", "dup_canonical_urls", "top_inlinked", "internal_outlinks", "internal_by_domain", "keyword_alignment"),
    "technical": ("tech_perf_domain", "slow_pages", "no_viewport_pages", "assets_by_category", "external_scripts", "large_images"),
    "key_metrics": ("key_metrics", "discovery_mix", "key_metrics_pages"),
    "competitor": ("ci_top_tags", "ci_top_pages", "ci_products", "ci_availability", "ci_price_by_domain", "ci_promos", "ci_pairs", "ci_inbound", "ci_outbound"),
    "indexability": ("noindex_summary", "noindex_pages", "robots_blocked"),
}


def rows(site: Site, name: str, **parameters) -> Iterable[dict]:
    """A report's rows, a partition at a time."""
    for r in report(name, site, **parameters).toLocalIterator():
        yield r.asDict(recursive=True)


def to_folder(site: Site, bundle: str, path: str, kind: str = "csv", **parameters) -> list[str]:
    """Each report of a bundle below path, as parts of CSV or lines of JSON. However long a list is, its rows don't pass the driver.
    Returns the reports written."""
    for name in BUNDLES[bundle]:
        df = report(name, site, **parameters)
        if kind == "csv":
            write_csv(df, f"{path}/{name}.csv", most=None)
        else:
            df.write.mode("overwrite").json(f"{path}/{name}.json")
    return list(BUNDLES[bundle])


def to_json(site: Site, name: str, **parameters) -> str:
    """A report, or a bundle as one document with a list for each report. For a browser: give caps, or use to_folder."""
    if name in BUNDLES:
        return json.dumps({n: list(rows(site, n, **parameters)) for n in BUNDLES[name]}, ensure_ascii=False)
    return json.dumps(list(rows(site, name, **parameters)), ensure_ascii=False)


def to_zip(site: Site, bundle: str, target, **parameters) -> None:
    """One CSV for each report that has rows; a note where none has. target: a path or a binary file. For capped reports, as one
    machine writes it; to_folder has no such bound."""
    written = 0
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for name in BUNDLES[bundle]:
            found = iter(rows(site, name, **parameters))
            if (first := next(found, None)) is None:
                continue
            with z.open(f"{name}.csv", "w") as raw, io.TextIOWrapper(raw, "utf-8", newline="") as text:
                out = csv.DictWriter(text, list(first), quoting=csv.QUOTE_ALL)
                out.writeheader()
                out.writerow(first)
                out.writerows(found)
            written += 1
        if not written:
            z.writestr("readme.txt", "No rows for this selection.\n")
